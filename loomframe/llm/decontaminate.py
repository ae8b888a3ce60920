"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of a partition's documents (about SHARD bytes). Its words become symbols of the benchmark's
vocabulary. A window can only occur where every pair of neighbouring words is a pair of the benchmark, so the shard's
text is cut at other pairs and runs shorter than the shortest window are left out; what remains is indexed. All windows
are searched backwards through the wavelet tree, occurrences are located by sampled suffix positions, and the words
they cover are merged into removal spans.

The benchmark is compiled in blocks of BLOCK characters; each block is one pass over the shards, and what the passes find is
united by row, so a large benchmark costs time, not memory. Words are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import frugal, materialize, run_hash, slices, split_words, table, text_bytes
from .fm_index import FMIndex

WINDOW, SHARD, BLOCK = 13, 4 << 20, 4 << 20

#: Word bytes after lower-casing A-Z: all but 00-2F, 3A-60 and 7B-7F.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of each word."""
    data = _LOWER[data]
    start, end, row = split_words(data, offsets, _IS_WORD)
    return run_hash(data, start, end), start, end, row


class Windows:
    """A block of the benchmark: vocabulary, word pairs, distinct windows and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        raw = [(t or "").encode() for _, t in items]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        h, _, _, row = word_hashes(data, offsets)
        self.vocabulary, code = np.unique(h, return_inverse=True)
        code = code + 2  # 0: end of the shard, 1: a cut
        bounds = np.searchsorted(row, np.arange(len(items) + 1))
        found: dict[tuple, set[str]] = {}
        pairs = set()
        for (item, _), a, b in zip(items, bounds[:-1], bounds[1:], strict=True):
            words = code[a:b].tolist()
            pairs.update(zip(words, words[1:], strict=False))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            self.patterns[i, : len(w)] = w
        self.items = [sorted(x) for x in found.values()]
        self.symbols = len(self.vocabulary) + 2
        self.pairs = np.array(sorted(a * self.symbols + b for a, b in pairs), np.int64)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def occurrences(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence among words with hashes h in documents row."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(h) or not len(self.lengths):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[at] == h, at + 2, 0)
        known = code > 0
        joined = known[:-1] & known[1:] & (row[:-1] == row[1:])
        if len(self.pairs):
            i = np.flatnonzero(joined)
            key = code[i] * self.symbols + code[i + 1]
            p = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[i] = self.pairs[p] == key
        else:
            joined[:] = False
        begin = known.copy()
        begin[1:] &= ~joined
        finish = known.copy()
        finish[:-1] &= ~joined
        a, b = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        long = b - a >= self.shortest
        a, b = a[long], b[long]
        if not len(a):
            return none
        size = b - a + 1  # a cut after each run
        first = np.cumsum(size) - size
        text = np.ones(int(size.sum()), np.int64)
        word = np.repeat(a - first, size) + np.arange(len(text))
        inside = np.ones(len(text), bool)
        inside[first + size - 1] = False
        text[inside] = code[word[inside]]
        index = FMIndex(text, self.symbols)
        lo, hi = index.search(self.patterns, self.lengths)
        n = hi - lo
        window = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return word[index.locate(rows)], window


def _merge(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Ranges [a, b) united."""
    out: list[list[int]] = []
    for x, y in sorted(zip(a.tolist(), b.tolist(), strict=True)):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FOUND = "n_words long, words array<struct<start:long,end:long>>, spans array<struct<start:long,end:long>>, items array<string>"


def _pass(docs: DataFrame, windows: Windows, keep: list[str]) -> DataFrame:
    """docs(text, keep...): keep... plus n_words, words, spans and items under one block of the benchmark."""
    held = docs.sparkSession.sparkContext.broadcast(windows)
    schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL(_FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for part in slices(batch, "text", SHARD):
                data, offsets = text_bytes(part.column(0))
                h, start, end, row = word_hashes(data, offsets)
                at, window = w.occurrences(h, row)
                base = np.searchsorted(row, np.arange(part.num_rows + 1))
                order = np.argsort(row[at], kind="stable")
                at, window = at[order], window[order]
                cut = np.searchsorted(row[at], np.arange(part.num_rows + 1))
                words, spans, items = [], [], []
                for i in range(part.num_rows):
                    a, b = cut[i], cut[i + 1]
                    if a == b:
                        words.append([]), spans.append([]), items.append([])
                        continue
                    s = at[a:b] - base[i]
                    merged = _merge(s, s + w.lengths[window[a:b]])
                    words.append([{"start": x, "end": y} for x, y in merged])
                    spans.append([{"start": int(start[base[i] + x] - offsets[i]), "end": int(end[base[i] + y - 1] - offsets[i])} for x, y in merged])
                    items.append(sorted({x for k in set(window[a:b].tolist()) for x in w.items[k]}))
                new = [pa.array(np.diff(base), pa.int64()), pa.array(words, pa.list_(_SPAN)), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], names=[f.name for f in schema])

    return docs.select("text", *keep).mapInArrow(frugal(run), schema)


def _united(parts: Column) -> Column:
    """Sorted lists of ranges as one list of ranges that neither overlap nor touch."""
    last = lambda a: F.element_at(a, -1)

    def add(a: Column, x: Column) -> Column:
        grown = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))
        return F.when((F.size(a) > 0) & (x["start"] <= F.try_element_at(a, F.lit(-1))["end"]), grown).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(F.flatten(parts)), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), add)


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of about `block` characters, one at a time on the driver."""
    held, size = [], 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        held.append((r["item"], r["text"]))
        size += len(r["text"])
        if size >= block:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_passages(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs(text, keep...): keep... plus n_words, words and spans (hit ranges in words and in UTF-8 bytes) and items (ids, as strings).

    benchmark(item_id, text): items without id or words take no part; an id given twice is one item with both texts.
    A benchmark of several blocks takes a pass for each, one after another; a pass writes the rows that it hits, and these are
    united by row at the end. So a task holds one block at a time, whatever the benchmark's size.
    """
    blocks = _blocks(benchmark, block)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _pass(docs, Windows(first, window), keep)
    rows = materialize(docs.select("text", F.struct(*keep).alias("row"), F.monotonically_increasing_id().alias("id")), "rows")
    found = materialize(_pass(rows, Windows(first, window), ["id"]), "found")
    counted, hit = found.select("id", "n_words"), found.where(F.size("items") > 0)
    for items in (x for xs in ((second,), blocks) for x in xs):
        hit = hit.union(materialize(_pass(rows, Windows(items, window), ["id"]).where(F.size("items") > 0), "found"))
    lists = [F.collect_list(c).alias(c) for c in ("words", "spans", "items")]
    hit = hit.groupBy("id").agg(*lists).select("id", _united(F.col("words")).alias("words"), _united(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    none = [F.coalesce(c, F.expr(f"cast(array() as {hit.schema[c].dataType.simpleString()})")).alias(c) for c in ("words", "spans", "items")]
    return rows.select("id", "row").join(counted, "id").join(hit, "id", "left").select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "n_words", *none)


def hits(found: DataFrame) -> DataFrame:
    """find_passages' rows plus n_hit and contaminated: at least a twentieth of the words are in occurrences."""
    n = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.withColumn("n_hit", n).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without byte ranges that begin and end at word edges."""
    data, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item.

    Null, empty and wordless texts: no words, no hits, not contaminated. An empty benchmark: no hits. Very long texts are a shard
    of their own. Null and repeated doc_ids are rows like others; an empty table gives no rows.
    """
    found = hits(find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"]))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the contamination rule marks go; all others, null and empty texts too, stay as they are."""
    whole = docs.select("text", F.struct(*docs.columns).alias("row"))
    return hits(find_passages(whole, table(spark, sf_dir, "benchmark"), ["row"])).where(~F.col("contaminated")).select("row.*")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') AS k, len(w[i:i+12]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
occ AS (SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT occ.r, occ.i, occ.n, win.item_id FROM occ JOIN win ON occ.k = win.k AND occ.n = win.n),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word ON d.r = word.r LEFT JOIN item ON d.r = item.r
"""
