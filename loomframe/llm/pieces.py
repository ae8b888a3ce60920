"""SentencePiece encoding and decoding over a relational lattice.

Texts are normalised as the model asks (a space before the text, spaces as U+2581) and cut wherever two neighbouring
characters stand together in no piece: no piece and no merge crosses such a place, so the words between cuts can be
encoded on their own. Distinct words are the lattice's unit:

- explode the substrings of up to the longest piece's length, and join them to the piece table (a vocabulary, so of
  bounded size; broadcast): the edges of the lattice;
- group the edges by word (they come out of the word's own partition, in its order: no further shuffle), and fold over them with
  `aggregate`: Viterbi for unigram models, the best piece sum; for merge models (BPE) the library's rule, merge the
  pair whose piece scores best, leftmost first, on a bit mask of the word's boundaries. Scores of a BPE model are merge
  ranks, not log likelihoods; their best sum is not what the library returns, so the fold follows the model's kind.

Encoded words go back to the texts by blocks of BLOCK_ROWS rows of a file: a block's words and its texts (both packed
and compressed) meet in one task as a stream, words first; the corpus's whole dictionary is never in one place. There
characters outside the vocabulary become byte pieces, and words longer than a mask's bits are merged by a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import frugal, materialize, run_hash, slices, small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Rows of a file that share a dictionary, for texts of less than LONG bytes; with each doubling of a text's size half as many do,
#: so that no block holds over BLOCK_ROWS * LONG bytes (or one text). Characters of a word that the mask's bits can hold.
BLOCK_ROWS, LONG, MASK_CHARS = 16384, 1 << 15, 48
#: Rows for each partition of the stream of blocks (blocks fall on them by hash), and partitions at most.
PART_ROWS, MOST_PARTS = 4096, 200_000
SPACE = "▁"


class Pieces:
    """The piece table: (text, id, score) of normal pieces, and ids of byte pieces."""

    def __init__(self, rows: list[tuple[str, int, float]], byte_ids: list[int] | None, unknown: int, kind: str):
        self.rows, self.byte_ids, self.unknown, self.kind = rows, byte_ids, unknown, kind
        self.longest = max((len(p) for p, _, _ in rows), default=1)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        skip = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
        rows = [(m.id_to_piece(i), i, m.get_score(i)) for i in ids if not skip(i)]
        bytes_ = [i for i in ids if m.is_byte(i)]
        merge = all(s == int(s) for _, _, s in rows)  # ranks
        return cls(rows, bytes_ if len(bytes_) == 256 else None, m.unk_id(), "merge" if merge else "viterbi")

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(class of each code point, which classes stand next to each other in a piece); class 0 stands nowhere."""
        pairs = {(a, b) for p, _, _ in self.rows for a, b in zip(p, p[1:], strict=False)}
        chars = sorted({c for pair in pairs for c in pair})
        number = {c: i + 1 for i, c in enumerate(chars)}
        of = np.zeros(0x110000, np.int32)
        for c, i in number.items():
            of[ord(c)] = i
        near = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in pairs:
            near[number[a], number[b]] = True
        return of, near

    def singles(self) -> frozenset[str]:
        return frozenset(p for p, _, _ in self.rows if len(p) == 1)

    def bound(self) -> frozenset[str]:
        """Characters that occur in longer pieces only."""
        return frozenset(c for p, _, _ in self.rows for c in p) - self.singles()

    def spellings(self) -> dict[int, bytes]:
        out = {i: p.encode() for p, i, _ in self.rows}
        return out | {i: bytes([b]) for b, i in enumerate(self.byte_ids or [])}


class Cutter:
    """Texts to words: code points, first places of words, and the text of each."""

    def __init__(self, classes: tuple[np.ndarray, np.ndarray]):
        self.of, near = classes
        self.near, self.classes = near.ravel(), np.int32(len(near))

    def __call__(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(all normalised texts, first place of each word and the end, row of each word, 64-bit hash of each word)."""
        parts = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(parts)
        ends = np.cumsum([len(p) for p in parts])
        u = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(u)
        if not n:
            z = np.zeros(0, np.int64)
            return joined, np.zeros(1, np.int64), z, z.astype(np.uint64)
        c = self.of[u]
        first = np.ones(n + 1, bool)
        first[1:-1] = ~self.near[c[:-1] * self.classes + c[1:]]
        first[ends] = True
        start = np.flatnonzero(first)
        per = np.diff(np.searchsorted(start, ends), prepend=0)
        return joined, start, np.repeat(np.arange(len(texts)), per), _hashes(joined, u, start)


def _hashes(joined: str, u: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words between neighbouring starts, by their bytes in UTF-8; u: the code points of joined."""
    wide = np.zeros(len(u) + 1, np.int32)  # bytes past one for each character
    np.cumsum((u > 0x7F).astype(np.int8) + (u > 0x7FF) + (u > 0xFFFF), out=wide[1:])
    at = start + wide[start]
    return run_hash(np.frombuffer(joined.encode(), np.uint8), at[:-1], at[1:])


def word_hash(words: list[str]) -> np.ndarray:
    joined = "".join(words)
    u = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    return _hashes(joined, u, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64))


def in_lattice(word: str, single: frozenset[str], bound: frozenset[str]) -> bool:
    """Whether the lattice covers a word: short enough for a mask, and every character a piece."""
    return len(word) <= MASK_CHARS and (len(word) > 1 or word in single) and (not bound or bound.isdisjoint(word))


class Known:
    """Hashes met before: a sorted array and those not yet sorted in."""

    def __init__(self) -> None:
        self.sorted = np.zeros(0, np.uint64)

    def new(self, h: np.ndarray) -> np.ndarray:
        """Which of some sorted, distinct hashes are new; they are known from now on."""
        at = np.searchsorted(self.sorted, h)
        fresh = np.ones(len(h), bool)
        inside = at < len(self.sorted)
        fresh[inside] = self.sorted[at[inside]] != h[inside]
        self.sorted = np.insert(self.sorted, at[fresh], h[fresh])
        return fresh


def _words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """docs(text, block): (block, word), the distinct words of each block that the lattice encodes, once a task."""
    held = docs.sparkSession.sparkContext.broadcast((pieces.classes(), pieces.singles(), pieces.bound()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, (_, single, bound) = Cutter(held.value[0]), held.value
        seen: dict[int, Known] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                blocks = part.column(1).to_numpy()
                joined, start, row, h = cutter(part.column(0).to_pylist())
                for block in np.unique(blocks) if len(row) else ():
                    seen[block] = seen.pop(block, None) or Known()
                    if len(seen) > 32:  # rows of a file come in order: blocks met long ago are done
                        del seen[next(iter(seen))]
                    own = np.flatnonzero((blocks == block)[row])
                    own = own[np.argsort(h[own])]
                    u = h[own]
                    one = np.append(True, u[1:] != u[:-1])[: len(u)]
                    new = own[one][seen[block].new(u[one])].tolist()
                    words = [joined[start[i] : start[i + 1]] for i in new]
                    words = [w for w in words if in_lattice(w, single, bound)]
                    yield pa.RecordBatch.from_pydict({"block": np.full(len(words), block), "word": pa.array(words, pa.string())})

    return docs.select("text", "block").mapInArrow(frugal(run), "block long, word string")


#: An edge as one number, the best merge the largest: rank, then the smaller start; 30, 6, 6 and 21 bits.
_RANK, _START, _SIZE = 33, 27, 21


def _masked(edge: Column, start: Column, size: Column) -> Column:
    """An edge with the bits of the boundaries inside it and at its ends."""
    left = lambda x, k: F.call_function("shiftleft", x, k)
    one = F.lit(1).cast("long")
    return F.struct(edge.alias("v"), left(left(one, size - 1) - one, start + 1).alias("inner"), left(left(one, size) + one, start).alias("ends"))


def _merge_fold(edges: Column, n: Column) -> Column:
    """The pieces that the merge rule leaves: edges, packed numbers with masks, of a word with n characters.

    Bit i of the state is a boundary before character i. An edge is a merge of two neighbours if both its ends are
    boundaries and just one lies inside. Boundaries never come back, so a step keeps only edges of which both ends, and
    something inside, still are.
    """
    one = F.lit(1).cast("long")
    once = lambda x, f: F.transform(F.array(x), f)[0]
    open_ends = lambda b, e: b.bitwiseAND(e["ends"]) == e["ends"]

    def merge(state: Column, best: Column) -> Column:
        alive = lambda b: F.filter(state["edges"], lambda e: open_ends(b, e) & (b.bitwiseAND(e["inner"]) != 0))
        return once(state["b"].bitwiseAND(F.bitwise_not(best["inner"])), lambda b: F.struct(b.alias("b"), alive(b).alias("edges")))

    def step(state: Column, _: Column) -> Column:
        best = F.array_max(F.filter(state["edges"], lambda e: F.bit_count(state["b"].bitwiseAND(e["inner"])) == 1))
        return F.when(F.size(state["edges"]) == 0, state).otherwise(once(best, lambda x: F.when(x.isNull(), state).otherwise(merge(state, x))))

    all_ = F.call_function("shiftleft", one, (n + 1).cast("int")) - one
    merges = F.filter(edges, lambda e: e["inner"] != 0)
    final = F.aggregate(F.sequence(F.lit(1), n), F.struct(all_.alias("b"), merges.alias("edges")), step, lambda s: s["b"])
    # the pieces are the edges between neighbouring boundaries; smaller starts have larger numbers in these bits
    kept = once(final, lambda b: F.filter(edges, lambda e: open_ends(b, e) & (b.bitwiseAND(e["inner"]) == 0)))
    placed = F.sort_array(F.transform(kept, lambda e: F.struct(F.shiftright(e["v"], _START).bitwiseAND(63).alias("start"), e["v"].bitwiseAND((1 << _SIZE) - 1).cast("int").alias("id"))), asc=False)
    return F.transform(placed, lambda e: e["id"])


def _viterbi_fold(edges: Column, n: Column) -> Column:
    """The path with the best sum of scores: at each place the best way to get there, as (score, ids)."""

    def step(state: Column, j: Column) -> Column:
        into = F.filter(edges, lambda e: e["start"] + e["size"] == j)
        ways = F.transform(into, lambda e: F.struct((state[e["start"]]["score"] + e["score"]).alias("score"), F.concat(state[e["start"]]["ids"], F.array(e["id"])).alias("ids")))
        best = F.array_max(F.filter(ways, lambda w: w["score"].isNotNull()))
        return F.concat(state, F.array(best))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.expr("cast(array() as array<int>)").alias("ids")))
    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), first, step), -1)["ids"]


def encode_words(words: DataFrame, pieces: Pieces, carry: str) -> DataFrame:
    """words(word, carry), distinct, of up to MASK_CHARS characters, dealt by word: (word, carry, ids).

    Substrings meet the pieces by a 64-bit hash, one number to look up, and then byte by byte. A number for each word that
    rises through a partition goes before the word in the grouping: edges come in its order, so nothing is left to sort.
    What a word carries goes with its first character's edge alone.
    """
    spark = words.sparkSession
    order = {s: k for k, s in enumerate(sorted({s for _, _, s in pieces.rows}))}  # the best score has the highest rank
    rows = [(p, i, s, order[s]) for p, i, s in pieces.rows]
    # a vocabulary: a model's, of fixed size
    piece_table = F.broadcast(spark.createDataFrame(rows, "piece string, id int, score double, rank long").withColumn("key", F.xxhash64("piece")))
    first = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.struct(i.alias("start"), F.when(i == 0, F.col(carry)).alias("carry")))
    starts = words.select("word", F.monotonically_increasing_id().alias("no"), first.alias("s")).select("word", "no", F.explode("s").alias("s")).select("word", "no", "s.*")
    sizes = starts.select("word", "no", "start", "carry", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length("word") - F.col("start")))).alias("size"))
    sizes = sizes.withColumn("carry", F.when(F.col("size") == 1, F.col("carry")))
    subs = sizes.withColumn("sub", F.substring("word", F.col("start") + 1, F.col("size")))
    edges = subs.withColumn("key", F.xxhash64("sub")).join(piece_table, "key").where(F.coalesce(F.startswith("sub", "piece") & F.startswith("piece", "sub"), F.lit(False)))
    if pieces.kind == "merge":
        long = lambda c, k: F.shiftleft(F.col(c).cast("long"), k)
        edge = long("rank", _RANK).bitwiseOR(F.shiftleft((F.lit(63) - F.col("start")).cast("long"), _START)).bitwiseOR(long("size", _SIZE)).bitwiseOR(F.col("id").cast("long"))
        edge = _masked(edge, F.col("start"), F.col("size"))
    else:
        edge = F.struct("start", "size", "id", "score")
    lattice = edges.groupBy("no", "word").agg(F.first("carry", ignorenulls=True).alias(carry), F.collect_list(edge).alias("edges"))
    fold = _merge_fold if pieces.kind == "merge" else _viterbi_fold
    return lattice.select("word", carry, fold(F.col("edges"), F.length("word")).alias("ids"))


def merge_word(word: str, score: dict[str, tuple[float, int]]) -> list[tuple[str, int | None]]:
    """The merge rule for one word, with a heap: (piece, id), id None for a character outside the table."""
    part: list[str | None] = list(word)
    left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and (s := score.get(both := part[i] + part[j])):
            heapq.heappush(heap, (-s[0], i, both))

    for i in range(len(part) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if part[i] is None or right[i] < 0 or part[i] + part[right[i]] != both:
            continue
        j = right[i]
        part[i], part[j], right[i] = both, None, right[j]
        if right[i] >= 0:
            left[right[i]] = i
            offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [(p, score[p][1] if p in score else None) for p in part if p is not None]


def best_path(word: str, score: dict[str, tuple[float, int]], longest: int) -> list[int]:
    """Viterbi for one word: the path with the best sum, of equal ones the last in order of ids."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])]
    for j in range(1, len(word) + 1):
        ways = [(best[i][0] + s[0], [*best[i][1], s[1]]) for i in range(max(0, j - longest), j) if best[i] is not None and (s := score.get(word[i:j]))]
        best.append(max(ways, default=None))
    return best[-1][1] if best[-1] else []


def _entries(coded: DataFrame) -> DataFrame:
    """coded(word, blocks, ids): (block, blob), the words of each block by hash with their ids, compressed; many words a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            if not batch.num_rows:
                continue
            h = word_hash(batch.column(0).to_pylist())
            blocks, ids = batch.column(1), batch.column(2)
            per = np.diff(blocks.offsets.to_numpy())
            word, block = np.repeat(np.arange(len(per)), per), blocks.flatten().to_numpy()
            n = np.diff(ids.offsets.to_numpy())
            first, flat = np.cumsum(n) - n, ids.flatten().to_numpy()
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(block[order]) != 0)) if len(order) else []
            for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
                w = word[order[a:b]]
                m = n[w]
                at = np.repeat(first[w] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                blob = np.array([len(w)], np.int64).tobytes() + h[w].tobytes() + m.astype(np.uint8).tobytes() + flat[at].astype(np.int32).tobytes()
                yield pa.RecordBatch.from_pydict({"block": pa.array([int(block[order[a]])], pa.int64()), "blob": pa.array([z.compress(blob)], pa.binary())})

    return coded.select("word", "blocks", "ids").mapInArrow(frugal(run), "block long, blob binary")


def _read_entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    h = np.frombuffer(blob, np.uint64, n, 8)
    return h, np.frombuffer(blob, np.uint8, n, 8 + 8 * n).astype(np.int64), np.frombuffer(blob, np.int32, -1, 8 + 9 * n)


def _packs(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(text, block, keep...): (block, blob), runs of rows of a block as compressed Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                blocks = part.column(1).to_numpy()
                cut = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    sink = pa.BufferOutputStream()
                    own = pa.Table.from_batches([part.slice(a, b - a)]).drop_columns(["block"])
                    with pa.ipc.new_stream(sink, own.schema) as w:
                        w.write_table(own)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([int(blocks[a])], pa.int64()), "blob": pa.array([z.compress(sink.getvalue().to_pybytes())], pa.binary())})

    return docs.select("text", "block", *keep).mapInArrow(frugal(run), "block long, blob binary")


class Speller:
    """Ids to bytes for many rows at once."""

    def __init__(self, spelling: dict[int, bytes]):
        size = max(spelling, default=0) + 1
        parts = [spelling.get(i, b"") for i in range(size)]
        self.size = np.array([len(p) for p in parts])
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _spelled(data: bytes) -> str:
    text = data.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def decode_ids(ids: list[int], speller: Speller) -> str:
    """The text of a row of ids; bytes that are no UTF-8 become U+FFFD."""
    return _spelled(speller(np.array(ids, np.int64)).tobytes())


def decode_rows(ids: np.ndarray, offsets: np.ndarray, speller: Speller) -> list[str]:
    """The same for many rows at once: ids[offsets[i]:offsets[i + 1]] are those of row i."""
    data = speller(ids).tobytes()
    at = np.concatenate([[0], np.cumsum(speller.size[ids])])[offsets].tolist()
    return [_spelled(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _blocked(docs: DataFrame, keep: list[str]) -> DataFrame:
    # 0 below LONG bytes, then one more with each doubling
    size = F.coalesce(F.greatest(F.floor(F.log2(F.octet_length("text") / LONG)) + 1, F.lit(0)), F.lit(0)).cast("int")
    rows = F.greatest(F.call_function("shiftright", F.lit(BLOCK_ROWS), size), F.lit(1))
    return docs.select("text", *keep, F.xxhash64("_metadata.file_path", size, F.floor(F.col("_metadata.row_index") / rows)).alias("block"))


def encode(docs: DataFrame, pieces: Pieces, keep: list[str]) -> DataFrame:
    """docs(text, keep...): keep..., n_tokens, ids, decoded (whether decoding the ids gives the text back).

    Null and empty texts have no ids. A text that holds U+2581 itself comes back with a space in its place: not decoded.
    Very long texts are rows like others; repeated rows each have their ids. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    try:
        blocked = _blocked(docs, keep)
    except AnalysisException:  # not a scan of files: make it one
        blocked = _blocked(materialize(docs.select("text", *keep), "texts"), keep)
    # one shuffle by word; a word's row holds a number for each block that asks for it
    words = _words(blocked, pieces).groupBy("word").agg(F.collect_list("block").alias("blocks"))
    coded = encode_words(words, pieces, "blocks")
    stream = _entries(coded).select("block", F.lit(0).alias("kind"), "blob").union(_packs(blocked, keep).select("block", F.lit(1).alias("kind"), "blob"))
    # about a block a partition, so that the batches that go to Python stay small; a partition of more blocks takes them in turn
    parts = min(MOST_PARTS, max(1, -(-docs.count() // PART_ROWS)))
    stream = stream.repartition(parts, "block").sortWithinPartitions("block", "kind")
    held = spark.sparkContext.broadcast((pieces.classes(), pieces.spellings(), pieces))
    schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL("n_tokens long, ids array<int>, decoded boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, spelling, pieces = held.value
        cutter, speller, z, rest = Cutter(classes), Speller(spelling), zstandard.ZstdDecompressor(), Rest(pieces)
        block, got, words = None, [], None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(blocks)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, got, words = blocks[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    got += [_read_entries(z.decompress(x.as_py())) for x in part.column(2)]
                    continue
                if words is None:
                    words, got = Dictionary(got), []
                for blob in part.column(2):
                    rows = pa.ipc.open_stream(z.decompress(blob.as_py())).read_all().combine_chunks()
                    texts = rows.column("text").to_pylist()
                    joined, start, row, h = cutter(texts)
                    count, ids = words(h, lambda i, joined=joined, start=start: rest(joined[start[i] : start[i + 1]]))
                    per = np.bincount(row, count, len(texts)).astype(np.int64) if len(row) else np.zeros(len(texts), np.int64)
                    offsets = np.concatenate([[0], np.cumsum(per)])
                    same = [back == (t or "") for back, t in zip(decode_rows(ids, offsets, speller), texts, strict=True)]
                    column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                    yield from pa.Table.from_arrays([*rows.drop_columns(["text"]).columns, pa.array(per), column, pa.array(same)], names=[f.name for f in schema]).to_batches()

    return stream.mapInArrow(frugal(run), schema)


class Rest:
    """Ids of words that are not in the lattice."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.score = pieces, {p: (s, i) for p, i, s in pieces.rows}
        self.single, self.bound = pieces.singles(), pieces.bound()

    def _outside(self, c: str) -> list[int]:
        p = self.pieces
        return [p.byte_ids[b] for b in c.encode()] if p.byte_ids else [p.unknown]

    def __call__(self, word: str) -> list[int]:
        if in_lattice(word, self.single, self.bound):
            raise ValueError("a word of the block is missing from its dictionary")
        if self.pieces.kind == "viterbi" and (path := best_path(word, self.score, self.pieces.longest)):
            return path
        return [x for p, i in merge_word(word, self.score) for x in ([i] if i is not None else self._outside(p))]


class Dictionary:
    """A block's words by hash, and their ids."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        h = np.concatenate([np.zeros(0, np.uint64), *[p[0] for p in parts]])
        size = np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]])
        self.ids = np.concatenate([np.zeros(0, np.int32), *[p[2] for p in parts]])
        start = np.cumsum(size) - size
        order = np.argsort(h, kind="stable")
        self.hash, self.start, self.size = h[order], start[order], size[order]
        # where the hashes of each beginning stand; the beginnings are more than the hashes, so few share one
        bits = max(1, min(30, len(h).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hash, np.arange(1 << bits).astype(np.uint64) << self.shift)
        self.until = np.append(self.hash, np.uint64(0xFFFFFFFFFFFFFFFF))

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[(h >> self.shift).astype(np.int64)]
        low = np.flatnonzero(self.until[at] < h)
        while len(low):
            at[low] += 1
            low = low[self.until[at[low]] < h[low]]
        return at, (self.until[at] == h) & (at < len(self.hash))

    def __call__(self, h: np.ndarray, spell: Callable[[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in order); spell(i) gives those of a word that is not listed."""
        if not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        at, known = self._find(h)
        if not known.all():
            u, first = np.unique(h[~known], return_index=True)
            own = [spell(int(i)) for i in np.flatnonzero(~known)[first]]
            self.__init__([(self.hash, self.size, self._flat()), (u, np.array([len(x) for x in own]), np.array([i for x in own for i in x], np.int32))])
            at, known = self._find(h)
        n = self.size[at]
        return n, self.ids[np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def _flat(self) -> np.ndarray:
        """All ids in the order of the hashes."""
        return self.ids[np.repeat(self.start - (np.cumsum(self.size) - self.size), self.size) + np.arange(int(self.size.sum()))]


def decode(coded: DataFrame, pieces: Pieces, keep: list[str]) -> DataFrame:
    """coded(ids, keep...): keep... and text. Null ids are a null text."""
    held = coded.sparkSession.sparkContext.broadcast(pieces.spellings())
    schema = StructType([*coded.select(*keep).schema, *StructType.fromDDL("text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(held.value)
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, speller) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[f.name for f in schema])

    return coded.select("ids", *keep).mapInArrow(run, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids under the model's own rule, and whether they decode to the text."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), Pieces.load(), ["doc_id"])


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the columns of documents but the text, then n_tokens, ids and decoded."""
    added = ["n_tokens", "ids", "decoded"]
    rest = [c for c in docs.columns if c not in ("text", *added)]
    whole = docs.select("text", F.struct(*rest).alias("row"))
    return encode(whole, Pieces.load(), ["row"]).select("row.*", *added)
