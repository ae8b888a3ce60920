"""Token ids as binary files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank by frequency (counted over all tokens), so the commonest take one byte. A block of
ids is a run of control bytes, two bits an id for its length of 1 to 4 bytes, four ids a control byte, and then the ids' bytes, low
byte first. Decoding looks all control bytes up in a table of 256 rows of four lengths; sums of the lengths are the places
of the ids, which are then read at once.

A folder holds `ranks` (Parquet: rank, id, n) and `ids`: files whose names, and blocks within a file, follow the ascending
order of doc_id. A block (little endian) is HEAD, then per document doc_id (8 bytes), whether it is null (1), its number of ids (4),
then control bytes, data bytes, and one zero byte, which the text sink writes.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, frugal, materialize, slices, small_batches, table, text_bytes

#: Magic, range, ids of the range before the block, documents, ids, data bytes, CRC of control and data bytes.
HEAD = struct.Struct("<4sIQIIII")
MAGIC = b"LFV1"
#: Ids of a block (a longer document is a block of its own), blocks of a file, ids of a range, about.
BLOCK_IDS, FILE_BLOCKS, RANGE_IDS = 1 << 18, 32, 1 << 25
#: Pieces of text that a worker remembers with their ids; words that are encoded at once.
MEMORY, JOINED = 400_000, 512

# --- text to ids -----------------------------------------------------------------------------------------------------------

_SPACE, _LETTER, _DIGIT, _MARK, _WIDE, _QUOTE = range(6)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[128:], _KIND[[9, 10, 11, 12, 13, 32]], _KIND[48:58], _KIND[39] = _WIDE, _SPACE, _DIGIT, _QUOTE
_KIND[65:91] = _KIND[97:123] = _LETTER
#: Whether a text may be cut between two bytes: never between two of a kind but digits, beside a byte of a longer character, or at a quote, but always at white space.
_CUT = np.ones((8, 8), bool)
for _k in (_SPACE, _LETTER, _MARK, _WIDE, _QUOTE):
    _CUT[_k, _k] = False
_CUT[_WIDE, 1:] = _CUT[1:, _WIDE] = _CUT[_QUOTE, 1:] = _CUT[1:, _QUOTE] = False
_CUT = _CUT.ravel()


class Known:
    """The ids of pieces of text that came before, one after another in an array."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        #: Without the places of ids in the text, where the library can leave them out.
        self.batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        #: Ids that end a word: a word of letters has exactly one, its last.
        self.ends = np.fromiter(((tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)), bool, size)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def encode(self, words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by piece) of words of ASCII letters, which are encoded many at a time, and of other pieces."""
        some = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.batch(some, add_special_tokens=False)), np.uint32)
        last = np.flatnonzero(self.ends[flat]) + 1
        if len(last) != len(words) or (len(last) and last[-1] != len(flat)):  # a vocabulary whose words do not end so
            words, others, flat, last = [], words + others, flat[:0], last[:0]
        ids = [e.ids for e in self.batch(others, add_special_tokens=False)]
        more = np.fromiter(chain.from_iterable(ids), np.uint32)
        return np.concatenate([flat, more]), np.concatenate([np.diff(last, prepend=0), np.fromiter(map(len, ids), np.int64, len(ids))])

    def __call__(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece: its ids are ids[start[number]:start[number + 1]]."""
        new = [p for p in pieces if p not in self.number]
        if len(self.number) + len(new) > MEMORY and self.number:
            self.forget()
            new = pieces
        words = [p for p in new if p.isascii() and p.isalpha()]
        new = words + [p for p in new if not (p.isascii() and p.isalpha())]
        flat, size = self.encode(words, new[len(words) :])
        start = self.start[-1] + np.cumsum(size)
        while self.start[-1] + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.start[-1] : self.start[-1] + len(flat)] = flat
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.start = np.concatenate([self.start, start])
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))


@lru_cache(maxsize=2)
def _loaded(path: str) -> Known:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Known(Tokenizer.from_file(path))


def vocabulary_size(path: str) -> int:
    return _loaded(path).tokenizer.get_vocab_size(with_added_tokens=True)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Texts as pieces between which the tokenizer always cuts, without white space, and the bounds of each text in them. ASCII capitals
    are lower-cased (not before a longer character, with which they may compose)."""
    capital = (data >= 65) & (data <= 90)
    capital[:-1] &= data[1:] < 128
    data = data + (capital.astype(np.uint8) << 5)
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _CUT[(kind[:-1] << 3) | kind[1:]]
    cut[offsets] = True
    # white space has no ids, and ends a piece on both sides
    kept = np.flatnonzero(kind != _SPACE)
    data, at, offsets = data[kept], np.append(np.flatnonzero(cut[kept]), len(kept)), np.searchsorted(kept, offsets)
    pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    return pieces.dictionary_encode(), np.searchsorted(at, offsets)


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start:start + size] of many ranges, one after another."""
    to = np.cumsum(size)
    return values[np.repeat(start - (to - size), size) + np.arange(to[-1] if len(to) else 0)]


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of texts, each followed by end_id: every piece is encoded once, and its ids are put where it stands.

    The word pattern of these vocabularies drops white space and never joins ASCII letters, digits and marks, so that pieces
    are encoded alike alone and in their text. Texts that may hold a special token are encoded whole.
    """
    texts = texts.fill_null("")
    whole = pc.match_substring(texts, "<|")
    data, offsets = text_bytes(pc.if_else(whole, "", texts))
    n = len(offsets) - 1
    if len(data):
        coded, bounds = _pieces(data, offsets)
        known = _loaded(path)
        number = known(coded.dictionary.to_pylist())
        start, size = known.start[number], known.start[number + 1] - known.start[number]
        code = coded.indices.to_numpy()
        size = size[code]
        ids = _gather(known.ids, start[code], size)
        bounds = np.concatenate([[0], np.cumsum(size)])[bounds]
    else:
        ids, bounds = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    if (rows := np.flatnonzero(whole.to_numpy(zero_copy_only=False))).size:
        own = [e.ids for e in _loaded(path).tokenizer.encode_batch([texts[int(i)].as_py() for i in rows], add_special_tokens=False)]
        ids = np.insert(ids, np.repeat(bounds[rows], [len(x) for x in own]), np.concatenate([np.asarray(x, np.uint32) for x in own]))
        more = np.zeros(n + 1, np.int64)
        more[rows + 1] = [len(x) for x in own]
        bounds = bounds + np.cumsum(more)
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(n + 1)


def width(size: int) -> str:
    """The numbers that hold the ids of a vocabulary in a table of tokens."""
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n, crc, ids binary): the ids, with end_id as the last, in numbers of the vocabulary's width; crc is of 32 bits each."""
    small_batches(docs.sparkSession)
    kind = width(vocabulary_size(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids, bounds = encode_texts(part.column(1), path, end_id)
                wide, raw = memoryview(ids.astype("<u4")).cast("B"), ids.astype(kind)
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                binary = pa.Array.from_buffers(pa.binary(), len(crc), [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n": pa.array(np.diff(bounds), pa.int64()), "crc": pa.array(crc, pa.int64()), "ids": binary})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(frugal(run), "doc_id long, n long, crc long, ids binary")


# --- the code --------------------------------------------------------------------------------------------------------------

#: The lengths that each control byte names.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of 32-bit numbers."""
    x = np.ascontiguousarray(numbers, "<u4")
    size = 1 + (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    bits = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    bits[: len(x)] = size - 1
    control = bits.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    return control.tobytes(), x.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n numbers of control and data bytes."""
    size = _LENGTHS[control].ravel()[:n]
    end = np.cumsum(size)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    at = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    return at[end - size] & _MASK[size]


def block(part: int, first: int, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A block without its last zero byte; docs: (doc_id, ranks)."""
    counts = np.array([len(x) for _, x in docs], "<u4")
    control, data = pack(np.concatenate([x for _, x in docs]))
    names = np.array([0 if i is None else i for i, _ in docs], "<i8").tobytes() + np.array([i is None for i, _ in docs], np.uint8).tobytes()
    return HEAD.pack(MAGIC, part, first, len(docs), int(counts.sum()), len(data), zlib.crc32(data, zlib.crc32(control))) + names + counts.tobytes() + control + data


def read_blocks(content: memoryview) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(range, ids of the range before, doc_ids, counts, ranks) of each block of a file, one at a time."""
    at, raw = 0, np.frombuffer(content, np.uint8)
    while at < len(raw):
        magic, part, first, docs, n, size, crc = HEAD.unpack_from(content, at)
        at += HEAD.size
        controls = -(-n // 4)
        body = at + 13 * docs
        if magic != MAGIC or zlib.crc32(content[body : body + controls + size]) != crc or content[body + controls + size] != 0:
            raise ValueError("not a block of token ids, or a damaged one")
        names, null = raw[at : at + 8 * docs].view("<i8").tolist(), raw[at + 8 * docs : at + 9 * docs].tolist()
        counts = raw[at + 9 * docs : body].copy().view("<u4").astype(np.int64)
        ranks = unpack(raw[body : body + controls], raw[body + controls : body + controls + size], n)
        yield part, first, [None if z else i for i, z in zip(names, null, strict=True)], counts, ranks
        at = body + controls + size + 1


# --- tables and files ------------------------------------------------------------------------------------------------------


def id_counts(tokens: DataFrame, size: int) -> DataFrame:
    """(id, n): how often each id stands in all tokens; counted where the tokens lie, then added up. size: of the vocabulary."""
    kind = width(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                some = np.frombuffer(ids.as_buffer(), kind)
                if len(some) < size:
                    np.add.at(count, some, 1)
                else:
                    count += np.bincount(some, minlength=size)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"id": pa.array(some, pa.int64()), "n": pa.array(count[some], pa.int64())})

    return tokens.select("ids").mapInArrow(frugal(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(tokens: DataFrame, out: str, size: int, block_ids: int = BLOCK_IDS, file_blocks: int = FILE_BLOCKS, range_ids: int = RANGE_IDS) -> None:
    """tokens(doc_id, n, crc, ids), a written table, to ranks and files under out. size: of the vocabulary; ids are smaller.

    Ranges of doc_id are dealt over the cluster. Rows without an id come first; rows that share an id are in the order of
    number and checksum of their ids, and a range may end between them, so that no id is bound to one task.
    """
    spark = tokens.sparkSession
    counts = sorted(((r["n"], r["id"]) for r in id_counts(tokens, size).collect()), key=lambda x: (-x[0], x[1]))  # bounded by the vocabulary
    spark.createDataFrame([(k, i, n) for k, (n, i) in enumerate(counts)], "rank long, id long, n long").coalesce(1).write.parquet(f"{out}/ranks")
    rank = np.zeros(size, np.uint32)
    rank[[i for _, i in counts]] = np.arange(len(counts))
    held, kind = spark.sparkContext.broadcast(rank), width(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank, first, docs, n = TaskContext.get().partitionId(), held.value, 0, [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ranks = rank[np.frombuffer(ids.as_buffer(), kind)]
                if docs and n + len(ranks) > block_ids:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([block(part, first, docs)], pa.binary())})
                    first, docs, n = first + n, [], 0
                docs.append((doc_id, ranks))
                n += len(ranks)
        if docs:
            yield pa.RecordBatch.from_pydict({"value": pa.array([block(part, first, docs)], pa.binary())})

    total = sum(n for n, _ in counts)
    order = ["doc_id", "n", "crc", "row"]
    ranged = tokens.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-total // range_ids)), *order).sortWithinPartitions(*order)
    packed = ranged.select("doc_id", "ids").mapInArrow(frugal(run), "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", file_blocks).text(f"{out}/ids")


def read_ids(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with_ids, the ids as 32-bit numbers."""
    id_of = np.array([r["id"] for r in spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()], "<u4")  # bounded by the vocabulary
    held = spark.sparkContext.broadcast(id_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, first, names, counts, ranks in read_blocks(memoryview(content.as_buffer())):
                    raw = memoryview(held.value[ranks].tobytes())
                    to = np.cumsum(counts)
                    ids = [raw[4 * (b - c) : 4 * b] for b, c in zip(to.tolist(), counts.tolist(), strict=True)]
                    rows = {"doc_id": pa.array(names, pa.int64()), "part": pa.array([part] * len(names), pa.int64()), "first": pa.array(first + to - counts, pa.int64())}
                    rows |= {"n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(map(zlib.crc32, ids), pa.int64())}
                    yield pa.RecordBatch.from_pydict(rows | ({"ids": pa.array(map(bytes, ids), pa.binary())} if with_ids else {}))

    files = spark.read.format("binaryFile").load(f"{out}/ids").select("content")
    rows = materialize(files.mapInArrow(frugal(run), "doc_id long, part long, first long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids), "read-ids")
    # a row for each range of RANGE_IDS ids: broadcast, and summed in one task
    ranges = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(ranges.select("part", before.alias("before"))), "part")
    return placed.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op11_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Ids of every whole text of documents, written to files and read back.

    Null and empty texts are one id, the end. Rows without doc_id come first; repeated rows each have their place. A very long text is
    a block of its own. An empty table makes no files with blocks and gives no rows. Only doc_id and text are read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    out = fresh_path(spark, "token-files")
    tokens = materialize(tokenised(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer), "tokens")
    write_ids(tokens, out, vocabulary_size(tokenizer))
    return read_ids(spark, out, with_ids=False)
