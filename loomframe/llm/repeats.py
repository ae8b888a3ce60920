"""Removal of repeated passages by suffix sorting, exact over the whole corpus.

1. Anchors. Each window of `width` bytes has an anchor, the rightmost of its 32-byte grams with the smallest hash: a
   function of the window's bytes, so equal windows have equal anchors at equal places. A maximal run of windows with
   one anchor is a context. Contexts are counted by (anchor, hash): a context that occurs twice is repeated as a whole,
   an anchor that occurs once has no repeated window. Both counts are combined before the shuffle.
2. Suffix sorting. Where an anchor has several different contexts, those that share half a window left or right of it
   with another (each context once) are cut into cells of 16 bytes in line with the anchor, and the cells' suffixes are sorted by linear grouping over Lyndon prefixes. Neighbours
   that share width / 16 - 1 cells form the classes of windows that can be equal; the bytes left and right of
   the shared cells, 16 in all, decide which are.
3. An anchor with more than HOT contexts is not gathered in one task: hashes of all its windows are counted instead,
   combined before the shuffle. No case is dropped; the results are the same.
4. The repeated windows of a context are brought to each of its occurrences, and merged by document.

Windows can also be counted in words: WORDS words in a row with what stands between them. Their grams are WORD_GRAM
words; the suffixes that are sorted are those of the words of an anchor's contexts. Several units of windows
go through the steps together, so texts are read, and brought to their contexts, once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import frugal, materialize, mix64, release, run_hash, slices, small_batches, split_words, table, text_bytes, wide_hashes, with_row_id
from .suffix import suffix_order

WIDTH, GRAM, CELL = 400, 32, 16
#: The pipeline's shortest repeated passage, in words between white space; words of a gram.
WORDS, WORD_GRAM = 51, 6
#: Contexts of an anchor that one task sorts at most; bytes that are sorted together, about; bytes of texts
#: that are searched for anchors at once (about ten numbers for each byte are held).
HOT, CHUNK, SEGMENT = 8192, 1 << 20, 1 << 19

_SPACED = np.ones(256, bool)
_SPACED[[32, *range(9, 14)]] = False


def _anchors(h: np.ndarray, p: np.ndarray, w: int) -> np.ndarray:
    """For the windows of w grams that start at p: the place of the rightmost gram with the smallest hash."""
    m = len(h)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(m).astype(np.uint64))
    full = np.full(-(-m // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:m] = key
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.uint64(0xFFFFFFFF) - (np.minimum(back[p], ahead[p + w - 1]) & np.uint64(0xFFFFFFFF))).astype(np.int64)


def contexts(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor place, anchor hash, context hash) of each context; places in data."""
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= width)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if not len(rows):
        return none
    h = wide_hashes(data, GRAM)
    n = size[rows] - width + 1
    p = np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    of = np.repeat(rows, n)
    anchor = _anchors(h, p, width - GRAM + 1)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    c = anchor[first]
    return of[first], p[first], p[last], c, h[c].view(np.int64), run_hash(data, p[first], p[last] + width).view(np.int64)


def word_contexts(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """The same for windows of words, given the words' starts, ends and rows: (row, first byte, byte after the last, anchor place, anchor hash, context hash)."""
    p = np.flatnonzero(row[: max(0, len(row) - words + 1)] == row[words - 1 :])
    if not len(p):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = run_hash(data, start[: len(start) - WORD_GRAM + 1], end[WORD_GRAM - 1 :])
    anchor = _anchors(h, p, words - WORD_GRAM + 1)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[p][1:] != row[p][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    a, b, c = start[p[first]], end[p[last] + words - 1], anchor[first]
    return row[p[first]], a, b, start[c], h[c].view(np.int64), run_hash(data, a, b).view(np.int64)


class Bytes:
    """Windows of `width` bytes."""

    def __init__(self, width: int):
        if width % CELL or width < 2 * GRAM:
            raise ValueError(f"width must be a multiple of {CELL}, at least {2 * GRAM}")
        self.width = self.least = width

    def contexts(self, data: np.ndarray, offsets: np.ndarray, segment: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, first byte in the row, length, lead, anchor hash, context hash) of each context."""
        # a very long text goes in pieces that overlap by all but one byte of a window: each window is in one piece
        one = len(offsets) == 2
        for a in range(0, max(1, len(data)), segment) if one else [0]:
            piece = data[a : a + segment + self.width - 1] if one else data
            ends = np.array([0, len(piece)]) if one else offsets
            row, p0, p1, c, anchor, ctx = contexts(piece, ends, self.width)
            yield row, p0 - ends[row] + a, p1 - p0 + self.width, c - p0, anchor, ctx

    def every(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of each window."""
        p = np.arange(len(data) - self.width + 1)
        return p, p + self.width

    def sides(self, data: bytes, lead: int) -> tuple[bytes | None, bytes | None]:
        """What stands left and right of the anchor, half a window each: every window holds one of them whole."""
        half = (self.width - GRAM + 1) // 2
        end = lead + GRAM + half
        return data[lead - half : lead] if lead >= half else None, data[end - half : end] if end <= len(data) else None

    def repeated(self, texts: list[bytes], leads: list[int]) -> list[list[dict]]:
        return [_ranges(p, p + self.width) for p in repeated_windows(texts, leads, self.width)]


class Words:
    """Windows of `words` words."""

    def __init__(self, words: int):
        self.words, self.least = words, 2 * words - 1

    def contexts(self, data: np.ndarray, offsets: np.ndarray, segment: int) -> Iterator[tuple[np.ndarray, ...]]:
        start, end, row = split_words(data, offsets, _SPACED)
        one = len(offsets) == 2
        for k in range(0, max(1, len(start)), segment // 8) if one else [0]:
            part = slice(k, k + segment // 8 + self.words - 1) if one else slice(None)
            s, e, r = start[part], end[part], row[part]
            at = s[0] if one and len(s) else 0
            piece = data[at : e[-1]] if one and len(s) else data
            of, a, b, c, anchor, ctx = word_contexts(piece, s - at, e - at, r, self.words)
            yield of, a + at - offsets[of], b - a, c - a, anchor, ctx

    def every(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, _ = split_words(data, np.array([0, len(data)]), _SPACED)
        return start[: len(start) - self.words + 1], end[self.words - 1 :]

    def sides(self, data: bytes, lead: int) -> tuple[bytes | None, bytes | None]:
        half = (self.words - WORD_GRAM + 1) // 2
        left, right = data[:lead].split()[-half:], data[lead:].split(None, WORD_GRAM + half)[WORD_GRAM : WORD_GRAM + half]
        return b" ".join(left) if len(left) == half else None, b" ".join(right) if len(right) == half else None

    def repeated(self, texts: list[bytes], leads: list[int]) -> list[list[dict]]:
        return [_ranges(a, b) for a, b in repeated_word_windows(texts, self.words)]


def _instances(docs: DataFrame, units: tuple[Bytes | Words, ...]) -> DataFrame:
    """docs(k1, text): the contexts of each unit u by document (of very long ones by pieces), places relative to the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SEGMENT):
                data, offsets = text_bytes(part.column(1))
                for u, unit in enumerate(units):
                    for row, off, size, lead, anchor, ctx in unit.contexts(data, offsets, SEGMENT):
                        # the unit is part of the anchor: units never share one
                        anchor = mix64(anchor.view(np.uint64) ^ np.uint64(u)).view(np.int64)
                        of, first = np.unique(row, return_index=True)
                        cut = pa.array(np.append(first, len(row)), pa.int32())
                        lists = [pa.ListArray.from_arrays(cut, pa.array(x, k)) for x, k in ((off, pa.int32()), (size, pa.int32()), (lead, pa.int32()), (anchor, pa.int64()), (ctx, pa.int64()))]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(np.full(len(of), u), pa.int8()), *lists], names=names)

    names = ["k1", "u", "off", "len", "lead", "anchor", "ctx"]
    kinds = "k1 long, u byte, off array<int>, len array<int>, lead array<int>, anchor array<long>, ctx array<long>"
    return docs.select("k1", "text").mapInArrow(frugal(run), kinds)


def repeated_windows(texts: list[bytes], leads: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each of some contexts, the places of windows that occur in another of them (or in the same at another place).

    texts must be different; leads: place of the anchor, modulo CELL the grid of the cells.
    """
    shared = width // CELL - 1
    size = np.array([len(x) for x in texts])
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = base + np.array(leads) % CELL
    cells = np.maximum(0, (base + size - first) // CELL)
    total = cells + 1  # an end after each context, different from all others
    start = np.cumsum(total) - total
    of = np.repeat(np.arange(len(texts)), total)
    place = np.repeat(first - CELL * start, total) + CELL * np.arange(int(total.sum()))
    is_end = np.zeros(len(of), bool)
    is_end[start + cells] = True
    code = np.zeros(len(of), np.int64)
    inner = np.flatnonzero(~is_end)
    code[inner] = np.unique(run_hash(data, place[inner], place[inner] + CELL), return_inverse=True)[1] + len(texts)
    code[is_end] = np.arange(len(texts), 0, -1) - 1  # the last end is the smallest symbol
    order = np.array(suffix_order(code.tolist()))
    whole = np.arange(len(of)) - start[of] + shared <= cells[of]
    order = order[whole[order]]
    out = [np.zeros(0, np.int64) for _ in texts]
    if len(order) < 2:
        return out
    same = np.ones(len(order) - 1, bool)
    for k in range(shared):
        same &= code[order[1:] + k] == code[order[:-1] + k]
    cls = np.concatenate([[0], np.cumsum(~same)])
    many = np.bincount(cls)[cls] > 1
    order, cls = order[many], cls[many].astype(np.uint64)
    if not len(order):
        return out
    at, text = place[order], of[order]
    near = np.concatenate([np.zeros(CELL, np.uint8), data, np.zeros(CELL, np.uint8)])
    around = np.empty((len(at), 2 * CELL), np.uint8)
    for k in range(CELL):
        around[:, k] = near[at + k]
        around[:, CELL + k] = near[np.minimum(at + shared * CELL + CELL + k, len(near) - 1)]
    found_p, found_of = [], []
    for left in range(CELL):
        p = at - left
        ok = np.flatnonzero((p >= base[text]) & (p + width <= base[text] + size[text]))
        if len(ok) < 2:
            continue
        edge = np.ascontiguousarray(around[ok, CELL - left : 2 * CELL - left]).view(np.uint64)
        with np.errstate(over="ignore"):
            key = mix64(mix64(mix64(cls[ok]) + edge[:, 0]) + edge[:, 1])
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = ok[count[inverse] > 1]
        found_p.append(p[hit] - base[text[hit]]), found_of.append(text[hit])
    if found_p:
        p, t = np.concatenate(found_p), np.concatenate(found_of)
        o = np.lexsort((p, t))
        p, t = p[o], t[o]
        cut = np.searchsorted(t, np.arange(len(texts) + 1))
        out = [p[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def repeated_word_windows(texts: list[bytes], words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of some different contexts, (start, end) of windows of words that occur in another of them (or in the same at another place)."""
    size = np.array([len(x) for x in texts])
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, end, of = split_words(data, np.append(base, len(data)), _SPACED)
    # a symbol is a word with what stands before it: all words of a window but its first, which is compared alone
    before = np.append(0, end[:-1])
    first = np.append(True, of[1:] != of[:-1])
    before[first] = start[first]
    n = np.bincount(of, minlength=len(texts))
    at = np.arange(len(start)) + of  # an end after each context, different from all others
    ends = np.cumsum(n + 1) - 1
    code = np.zeros(len(start) + len(texts), np.int64)
    code[at] = np.unique(run_hash(data, before, end), return_inverse=True)[1] + len(texts)
    code[ends] = np.arange(len(texts), 0, -1) - 1
    back = np.full(len(code), -1)
    back[at] = np.arange(len(start))
    order = np.array(suffix_order(code.tolist()))
    # suffixes that begin with the second word of a window
    w = back[np.maximum(order - 1, 0)]
    ok = (order > 0) & (back[order] >= 0) & (w >= 0)
    last = w + words - 1
    ok &= (last < len(start)) & (of[np.minimum(last, len(start) - 1)] == of[w])
    order, w = order[ok], w[ok]
    p = np.zeros(0, np.int64)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for k in range(words - 1):
            same &= code[order[1:] + k] == code[order[:-1] + k]
        cls = np.concatenate([[0], np.cumsum(~same)])
        pair = np.stack([cls.astype(np.uint64), run_hash(data, start[w], end[w])], axis=1)
        _, inverse, count = np.unique(pair, axis=0, return_inverse=True, return_counts=True)
        p = np.sort(w[count[inverse.ravel()] > 1])
    cut = np.searchsorted(of[p], np.arange(len(texts) + 1))
    return [(start[p[a:b]] - base[k], end[p[a:b] + words - 1] - base[k]) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def _ranges(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Sorted windows as byte ranges, those that overlap in one."""
    if not len(start):
        return []
    gap = np.flatnonzero(start[1:] > end[:-1])
    return [{"a": int(x), "b": int(y)} for x, y in zip(start[np.append(0, gap + 1)], end[np.append(gap, len(end) - 1)], strict=True)]


_RANGE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_contexts(bytes_: DataFrame, units: tuple[Bytes | Words, ...]) -> DataFrame:
    """bytes_(u, anchor, ctx, n, lead, bytes), whole anchors side by side in a partition: (anchor, ctx, ranges) where n = 1."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        unit = units[rows[0][0]]
        # a window that two contexts share has half of it on one side of the anchor: contexts that share neither side have none
        sides = [[(r[1], k, x) for k, x in enumerate(unit.sides(r[5], r[4])) if x is not None] for r in rows]
        count = Counter(x for s in sides for x in s)
        rows = [r for r, s in zip(rows, sides, strict=True) if any(count[x] > 1 for x in s)]
        marks = unit.repeated([r[5] for r in rows], [r[4] for r in rows]) if len(rows) > 1 else [()] * len(rows)
        kept = [(r[1], r[2], m) for r, m in zip(rows, marks, strict=True) if r[3] == 1 and len(m)]
        return pa.RecordBatch.from_pydict({"anchor": pa.array([x[0] for x in kept], pa.int64()), "ctx": pa.array([x[1] for x in kept], pa.int64()), "ranges": pa.array([x[2] for x in kept], _RANGE)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if rows and (r[0] != rows[-1][0] or held >= CHUNK and r[1] != rows[-1][1]):
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[5])
        if rows:
            yield solve(rows)

    return bytes_.select("u", "anchor", "ctx", "n", "lead", "bytes").mapInArrow(frugal(run), "anchor long, ctx long, ranges array<struct<a:int,b:int>>")


def _counted_contexts(bytes_: DataFrame, units: tuple[Bytes | Words, ...]) -> DataFrame:
    """The same for anchors with very many contexts, by counting window hashes over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, anchor, ctx, n, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                x = np.frombuffer(data, np.uint8)
                a, b = units[u].every(x)
                h = run_hash(x, a, b).view(np.int64)
                yield pa.RecordBatch.from_pydict({"anchor": np.full(len(a), anchor), "ctx": np.full(len(a), ctx), "n": np.full(len(a), n), "a": a.astype(np.int32), "b": b.astype(np.int32), "w": h})

    w = bytes_.select("u", "anchor", "ctx", "n", "bytes").mapInArrow(frugal(run), "anchor long, ctx long, n long, a int, b int, w long")
    twice = w.groupBy("anchor", "w").agg(F.count("*").alias("m")).where("m > 1").select("anchor", "w")
    hit = w.where("n = 1").join(twice, ["anchor", "w"], "left_semi")
    return hit.groupBy("anchor", "ctx").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def repeated_spans(keyed: DataFrame, *units: Bytes | Words, tidy: bool = False) -> DataFrame:
    """keyed(k1, text), k1 each row's own: (k1, spans), distinct byte ranges (u, a, b) of repeated windows, not merged. tidy: only they stay in the shared folder."""
    lists = materialize(_instances(keyed.where(F.octet_length("text") >= min(x.least for x in units)), units), "contexts")
    inst = lists.select("k1", "u", F.explode(F.arrays_zip("off", "len", "lead", "anchor", "ctx")).alias("c")).select("k1", "u", "c.*")
    # two numbers for four: rows of a shuffle are as wide as they have columns
    place = F.shiftleft(F.col("off").cast("long"), 8).bitwiseOR(F.col("u").cast("long"))
    reach = F.shiftleft(F.col("len").cast("long"), 32).bitwiseOR(F.col("lead").cast("long"))
    ctx = inst.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.first("k1").alias("k1"), F.first(place).alias("place"), F.first(reach).alias("reach"))
    anchors = ctx.groupBy("anchor").agg(F.count("*").alias("d"), F.sum("n").alias("t")).where("t > 1")
    at = [F.col("place").bitwiseAND(255).cast("byte").alias("u"), F.shiftright("place", 8).cast("int").alias("off"), F.shiftright("reach", 32).cast("int").alias("len"), F.col("reach").bitwiseAND((1 << 32) - 1).cast("int").alias("lead")]
    ctx = materialize(ctx.join(anchors, "anchor").select("anchor", "ctx", "n", "d", "k1", *at), "repeated")
    whole = ctx.where("n > 1").select("anchor", "ctx", F.array(F.struct(F.lit(0).alias("a"), F.col("len").alias("b"))).alias("ranges"))
    asked = ctx.where("d > 1").groupBy("k1").agg(F.collect_list(F.struct("u", "anchor", "ctx", "n", "d", "lead", "off", "len")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SEGMENT):
                data, offsets = text_bytes(part.column(0))
                lists = part.column(1)
                x, data = lists.flatten(), data.tobytes()
                first = np.repeat(offsets[:-1], lists.value_lengths().to_numpy()) + x.field("off").to_numpy()
                last = first + x.field("len").to_numpy()
                of = {f: x.field(f) for f in ("u", "anchor", "ctx", "n", "d", "lead")}
                yield pa.RecordBatch.from_arrays([*of.values(), pa.array([data[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())], names=[*of, "bytes"])

    # each context is asked of the one row that its place is of, whatever copies it has
    texts = keyed.select("k1", "text").join(asked, "k1").select("text", "asked")
    mixed = texts.mapInArrow(frugal(cut), "u byte, anchor long, ctx long, n long, d long, lead int, bytes binary")
    mixed = materialize(mixed, "bytes")
    near = mixed.where(F.col("d") <= HOT).repartition("anchor").sortWithinPartitions("u", "anchor", "ctx", "n")
    found = whole.union(_sorted_contexts(near, units)).union(_counted_contexts(mixed.where(F.col("d") > HOT), units))
    # `found` has a row for each context, `inst` one for each occurrence: a context with very many is a skewed side that AQE splits
    placed = inst.select("k1", "u", "off", "anchor", "ctx").join(found, ["anchor", "ctx"]).select("k1", "u", "off", F.explode("ranges").alias("r"))
    span = F.struct("u", (F.col("off") + F.col("r.a")).alias("a"), (F.col("off") + F.col("r.b")).alias("b"))
    # a span that several contexts give is taken once, before the shuffle too
    spans = materialize(placed.groupBy("k1").agg(F.collect_set(span).alias("spans")), "spans")
    if tidy:  # before the texts go through a shuffle once more
        release(lists, ctx, mixed)
    return spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, keep: list[str], *units: Bytes | Words, cut: int | None = None, tidy: bool = False) -> DataFrame:
    """docs(text, keep...): keep..., n_bytes, n_removed, n_spans, spans (merged), rest (binary), kept_sha256: texts without the repeated windows of the first `cut` units (all, if None); passages, passage_bytes: number and bytes of the other units' merged windows. tidy: as in repeated_spans."""
    small_batches(docs.sparkSession)
    # a number of each row's own, not of its id and text: copies without an id would share it, and meet in one task
    rows = with_row_id(docs.select("text", *keep))
    first = len(units) if cut is None else cut
    added = "n_bytes long, n_removed long, n_spans long, spans array<struct<a:int,b:int>>, rest binary, kept_sha256 string, passages long, passage_bytes long"
    schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL(added)])
    kinds = [pa.int64()] * 3 + [_RANGE, pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                out: list[list] = [[] for _ in kinds]
                for text, spans in zip(part.column(0), part.column(1), strict=True):
                    data = text.as_buffer().to_pybytes() if text.is_valid else b""
                    own, other = [], []
                    if spans.is_valid:
                        for u, a, b in zip(*(spans.values.field(f).to_pylist() for f in ("u", "a", "b")), strict=True):
                            (own if u < first else other).append((a, b))
                    merged, more = _merged(own), _merged(other)
                    rest, at = [], 0
                    for a, b in merged:
                        rest.append(data[at:a])
                        at = b
                    kept = b"".join([*rest, data[at:]])
                    found = (len(data), len(data) - len(kept), len(merged), [{"a": a, "b": b} for a, b in merged], kept, hashlib.sha256(kept).hexdigest(), len(more), sum(b - a for a, b in more))
                    for x, v in zip(out, found, strict=True):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=[f.name for f in schema])

    spans = repeated_spans(rows.select(F.col("_rid").alias("k1"), "text"), *units, tidy=tidy)
    return rows.join(spans.withColumnRenamed("k1", "_rid"), "_rid", "left").select("text", "spans", *keep).mapInArrow(frugal(run), schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that also start elsewhere.

    Null text: empty. Texts under 400 bytes and empty ones lose nothing; equal texts, and rows given twice, lose all that is
    400 bytes long or more; very long texts go in pieces that overlap. Null and repeated doc_ids are rows like others.
    An empty table gives no rows.

    Passages of over 50 words can be shorter than 400 bytes and then stay, as the 400 bytes say. has_passage (with
    n_passages and passage_bytes) tells which documents hold passages of 51 words that also start elsewhere, whatever their bytes.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_repeats(docs, ["doc_id"], Bytes(WIDTH), Words(WORDS), cut=1, tidy=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("passages") > 0).alias("has_passage"), F.col("passages").alias("n_passages"), "passage_bytes")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: passages of 51 words, and of 400 bytes, that also start elsewhere leave the texts; a text of which nothing is left goes, one that was empty stays.

    A cut can fall inside a character; such broken ends are dropped. n_chars follows the text. Null and empty texts, null and
    repeated ids stay as they are; rows with equal texts (an earlier stage leaves one of each) lose all of them.
    """
    # a text goes through the shuffle once: what is left of it is the text itself where nothing was removed
    whole = docs.select("text", F.col("text").isNotNull().alias("has_text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    out = without_repeats(whole, ["has_text", "row"], Bytes(WIDTH), Words(WORDS), tidy=True).where("n_removed = 0 OR n_removed < n_bytes")
    text = F.when(F.col("n_removed") == 0, F.when(F.col("has_text"), F.col("rest").cast("string"))).otherwise(F.expr("try_validate_utf8(cast(rest as string))"))
    text = F.coalesce(text, F.when(F.col("n_removed") > 0, F.expr("replace(make_valid_utf8(cast(rest as string)), '\ufffd', '')")))
    fixed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[fixed[c].alias(c) if c in fixed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: Windows of 400 bytes as 800 hexadecimal digits, windows of 51 words by their first and last byte; u: 0 the former, 1 the latter.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT r, i AS a, i + 400 AS b, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM d WHERE length(x) >= 800)),
tok AS (SELECT r, unnest(ts) AS s, generate_subscripts(ts, 1) AS k FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts FROM d)),
ends AS MATERIALIZED (SELECT r, s, k, sum(strlen(s)) OVER (PARTITION BY r ORDER BY k)::BIGINT AS e FROM tok),
word AS (SELECT r, e - strlen(s) AS a, e AS b, k FROM ends WHERE NOT regexp_matches(s, '^[\x20\x09-\x0D]')),
win AS (SELECT r, a, b FROM (SELECT r, a, lead(b, 50) OVER (PARTITION BY r ORDER BY k) AS b FROM word) WHERE b IS NOT NULL),
v AS MATERIALIZED (SELECT win.r, a, b, md5(substr(x, 2 * a + 1, 2 * (b - a))) AS h FROM win JOIN d ON win.r = d.r),
hit AS MATERIALIZED (SELECT 0 AS u, r, a, b FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) UNION ALL SELECT 1, r, a, b FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)),
run AS (SELECT u, r, a, b, sum(CASE WHEN a <= p THEN 0 ELSE 1 END) OVER (PARTITION BY u, r ORDER BY a) AS g FROM (SELECT *, lag(b) OVER (PARTITION BY u, r ORDER BY a) AS p FROM hit)),
span AS MATERIALIZED (SELECT u, r, min(a) AS a, max(b) AS b FROM run GROUP BY u, r, g),
gap AS (SELECT u, r, a, b, coalesce(lag(b) OVER (PARTITION BY u, r ORDER BY a), 0) AS p FROM span),
cut AS (SELECT d.r, sum(b - a)::BIGINT AS n, count(*) AS k, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS rest FROM gap JOIN d ON gap.r = d.r WHERE u = 0 GROUP BY d.r),
more AS (SELECT r, count(*) AS k, sum(b - a)::BIGINT AS n FROM span WHERE u = 1 GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(cut.n, 0) AS n_removed, coalesce(cut.k, 0) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256,
  more.k IS NOT NULL AS has_passage, coalesce(more.k, 0) AS n_passages, coalesce(more.n, 0) AS passage_bytes
FROM d LEFT JOIN cut ON d.r = cut.r LEFT JOIN more ON d.r = more.r
"""
