"""MinHash near-duplicates with circulant signatures, banding and exact Jaccard verification.

Two permutations of a universe of 2 ** UNIVERSE places make all coordinates: the first scatters a shingle's hash, the
second, circularly shifted by k, gives the values of coordinate k. A shingle's values for all coordinates are then
one contiguous stretch of the second permutation.

Documents with equal shingle sets are one node (combined before the shuffle, so thousands of copies cost nothing
more). Nodes that share a band are candidates. In each band bucket every node is first compared with the bucket's
smallest and largest node, a number of pairs that grows with the bucket, not its square. Verified links are joined into
components. What is left are nodes with one leader (the smallest of a bucket) that are still in different components: they
are dealt into blocks of BLOCK nodes, and blocks are compared as matrices, without a row for each pair; only links that
join two components come out. So no link is lost. With BANDS bands of ROWS rows a pair at 0.8 is missed with a chance of 7
in a million, at 0.85 of 3 in a hundred million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, materialize, mix64, release, run_hash, slices, split_words, table, text_bytes, with_row_id
from .graph import components

UNIVERSE, BANDS, ROWS, SEED = 20, 30, 5, 7
#: Nodes and bytes of a block of one leader's group, about.
BLOCK, BLOCK_BYTES = 512, 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words: all bytes but space and 09-0D.
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of each text, sorted, as 64-bit hashes; shorter texts are one shingle."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    start, end, row = split_words(data, offsets, _IS_WORD)
    h = run_hash(data, start, end)
    n = len(offsets) - 1
    bounds = np.searchsorted(row, np.arange(n + 1))
    with np.errstate(over="ignore"):
        wide = h
        for k in range(1, width):
            wide = mix64(wide[:-1]) + h[k:] if len(wide) else wide
    out, cut = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= width:
            s = np.unique(wide[a : b - width + 1])
        elif b > a:
            s = np.zeros(1, np.uint64)
            for x in h[a:b]:
                s = mix64(s) + x
            s = mix64(s + np.uint64(b - a))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
        cut[i + 1] = cut[i] + len(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), cut


class Circulant:
    """Signatures of `size` coordinates from two permutations."""

    def __init__(self, size: int, universe: int = UNIVERSE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = 1 << universe
        self.mask, self.size = np.uint64(d - 1), size
        self.scatter = rng.permutation(d).astype(np.int32)
        values = rng.permutation(d).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: size - 1]]), size)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        at = self.scatter[(shingles & self.mask).astype(np.int64)]
        out = np.full(self.size, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(at), 4096):
            np.minimum(out, self.shifted[at[i : i + 4096]].min(axis=0), out=out)
        return out


def _band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        for c in sig.reshape(bands, rows).T:
            x = mix64(x + c.astype(np.uint64))
    return x.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text): doc_id, n (set size), fa and fb (fingerprint of the set), bands (empty for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(bands * rows)
        for batch in batches:
            for part in slices(batch, "text"):
                sets, cut = shingle_sets(part.column(1), width)
                fa, fb, keys = [], [], []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    s = sets[a:b]
                    with np.errstate(over="ignore"):
                        fa.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                        fb.append(int(np.bitwise_xor.reduce(mix64(s + np.uint64(99))).view(np.int64)) if len(s) else 0)
                    keys.append(_band_hashes(circulant(s), bands, rows) if len(s) else [])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n": pa.array(np.diff(cut), pa.int64()), "fa": pa.array(fa, pa.int64()), "fb": pa.array(fb, pa.int64()), "bands": pa.array(keys, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), "doc_id long, n long, fa long, fb long, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles binary) for the documents named in nodes(node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, cut = shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_pydict({"node": part.column(0), "shingles": pa.array([sets[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    # the candidates grow with the corpus: never broadcast, at any size
    return docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.hint("merge"), "node", "left_semi").mapInArrow(frugal(run), "node long, shingles binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) whose full sets satisfy 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    sized = (F.length("x") * 100 >= F.length("y") * percent) & (F.length("y") * 100 >= F.length("x") * percent)
    return x.where(sized).select("a", "b", "x", "y").mapInArrow(frugal(run), "a long, b long")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of incidence matrices over shingles that occur twice."""
    both = [*x, *y]
    of = np.repeat(np.arange(len(both)), [len(s) for s in both])
    values, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    of, column = of[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [c, c + 4096])
        m = np.zeros((len(both), 4096), np.float32)
        m[of[a:b], column[a:b] - c] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


def joining_links(labels: np.ndarray, sets: list[np.ndarray], block: np.ndarray, i: int, j: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of labels that a link between block i and block j joins, a spanning forest of them."""
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return []
    x, y = [sets[k] for k in left], [sets[k] for k in right]
    n, m = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    common = _overlaps(x, y).astype(np.int64)
    hit = (100 * common >= percent * (n[:, None] + m[None, :] - common)) & (labels[left][:, None] != labels[right][None, :])
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while (u := parent.get(v, v)) != v:
            v = u
        return v

    out = []
    for p, q in zip(*(k.tolist() for k in np.nonzero(hit)), strict=True):
        a, b = find(int(labels[left[p]])), find(int(labels[right[q]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((min(a, b), max(a, b)))
    return out


def _links_in_groups(shared: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """shared(lo, node), label(node, label): pairs of labels joined by links between nodes with one leader, the same in every run."""
    member = shared.where("node <> lo").select(F.col("lo").alias("g"), "node").distinct()
    member = member.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sized = member.join(sets.select("node", F.length("shingles").alias("size")).distinct(), "node")
    mixed = sized.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"), F.sum("size").alias("bytes")).where("x <> y")
    k = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = member.join(mixed.select("g", k.alias("k")), "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.select("g", "node", "label", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    dealt = dealt.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", "block")
    dealt = dealt.join(sets, "node").select("g", "i", "j", "node", "label", "block", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> list[tuple[int, int]]:
            if key is None or len(rows) < 2:
                return []
            labels, block, sets_ = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows]
            return joining_links(labels, sets_, block, key[1], key[2], percent)

        out: list[tuple[int, int]] = []
        for batch in batches:
            for g, i, j, lab, block, data in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5, 6)), strict=True):
                if (g, i, j) != key:
                    out += done()
                    key, rows = (g, i, j), []
                rows.append((lab, block, data))
        out += done()
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "node").mapInArrow(frugal(run), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text): doc_id, n_shingles, component_id, kept for each row.

    Ids are the vertices: rows that share an id are one vertex with the links of all their texts. Texts without words are linked with nothing; rows without
    doc_id are not linked, have no component and are kept.
    """
    sig = materialize(signatures(docs, width, bands, rows), "signatures")
    nodes = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")
    member = nodes.select("node", F.explode("bands").alias("h"))
    ends = member.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    shared = materialize(member.join(ends, "h").select("node", "lo", "hi").distinct(), "shared")
    tried = shared.select(F.explode(F.array("lo", "hi")).alias("a"), F.col("node").alias("b")).where("a <> b")
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = materialize(_sets(docs, shared.select("node").distinct(), width), "sets")
    label = components(_verify(tried, sets, percent))
    more = components(_links_in_groups(shared, label, sets, percent)).select(F.col("node").alias("label"), F.col("label").alias("last"))
    release(sets, shared)  # components are written tables by now
    named = nodes.select("fa", "fb", "n", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(more, "label", "left").select("fa", "fb", "n", F.coalesce("last", "label").alias("component_id"))
    out = sig.select("doc_id", "n", "fa", "fb").join(named, ["fa", "fb", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one row stays (five words, 0.8): the smallest doc_id's; of several, that of the smallest fingerprint.

    Groups are of rows: rows that share an id are linked like any others, and so are rows without an id, which go first.
    """
    rows = with_row_id(docs)
    member = near_duplicates(rows.select(F.col("_rid").alias("doc_id"), "text")).select(F.col("doc_id").alias("_rid"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_print", "_rid")
    named = rows.select("_rid", "doc_id", F.xxhash64("text").alias("_print"))
    first = member.join(named.hint("merge"), "_rid").groupBy("component_id").agg(F.min(order)["_rid"].alias("_rid"))
    return rows.join(first.select("_rid").hint("merge"), "_rid", "left_semi").select(*docs.columns)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least_id ON w.doc_id = a
"""
