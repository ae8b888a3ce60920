"""The prefix trie of conversations, by preorder intervals.

A node is a distinct sequence of first turns. Distinct whole conversations are ranked in lexicographic order (of the hashes of
their turns, place by place), so the members of a node are an interval of ranks, and (first member, depth) puts
the nodes in preorder. A node's subtree ends where the last member's nodes end; leaves and savings of a subtree are
differences of running sums over the preorder at those two places. Running sums are made by ranges over the cluster.

Texts are read once, for their hashes. Prefixes are named by the exclusive or of their turns' hashes with their places, which
running sums give too. Equal conversations are combined before they are ranked or cut into nodes. Rows move by keys
that can be hot only as a table's side that a join may split, or as sums that are combined before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, frugal, materialize, table

#: Turns in a key of the ranking, conversations in a piece of a list of members, rows of a range, about.
CHUNK, PIECE, RANGE_ROWS = 64, 1 << 15, 1_000_000
NO_BYTES = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, order: list[str], sums: tuple[str, ...] = (), xors: tuple[str, ...] = (), name: str = "running") -> DataFrame:
    """rows plus, for each column c of sums (of xors), c_to: the sum (exclusive or) of all rows up to this one in a total order.

    A range shuffle; each range adds up its rows as they stream by; the ranges' totals, a row for each RANGE_ROWS rows, are broadcast.
    """
    kept = [*sums, *xors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = TaskContext.get().partitionId(), dict.fromkeys(kept, np.int64(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            out = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64))]
            for c in kept:
                x = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                to = np.cumsum(x) + state[c] if c in sums else np.bitwise_xor.accumulate(x) ^ state[c]
                state[c] = to[-1]
                out.append(pa.array(to))
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, "_part", *[f"_{c}" for c in kept]])

    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "_part long", *[f"_{c} long" for c in kept]])
    ranged = materialize(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(frugal(run), fields), name)
    total = ranged.groupBy("_part").agg(*[(F.sum(c) if c in sums else F.bit_xor(c)).alias(c) for c in kept])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select("_part", *[F.coalesce((F.sum(c) if c in sums else F.bit_xor(c)).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in kept])
    whole = [(F.col(f"_{c}") + F.col(f"_before_{c}") if c in sums else F.col(f"_{c}").bitwiseXOR(F.col(f"_before_{c}"))).alias(f"{c}_to") for c in kept]
    return ranged.join(F.broadcast(before), "_part").select(*rows.columns, *whole)


def _xor(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.col(b))


def rebuilt(turns: DataFrame, span: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, turn, role, text) to (conversations (c, n turns), their turns (c, d from 1, h, size)).

    Conversation c gets the first crc32(c) % most turns of conversation c - c % span, then its own turns after as many.
    Turns that share conversation and number are in the order of their hash. Rows without conv_id belong to no conversation.
    """
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("h"), F.octet_length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("one")
    )
    placed = running(materialize(hashed, "turns"), ["c", "turn", "h"], ("one",), name="placed")
    path = fresh_path(spark, "convs")
    placed.groupBy("c").agg(F.min("one_to").alias("first"), F.count("*").alias("own")).withColumn("cut", F.crc32(F.col("c").cast("string")) % most).withColumn("base", F.expr(f"c - c % {span}L")).write.parquet(path)
    convs = spark.read.parquet(path)
    convs = convs.join(convs.select(F.col("c").alias("base"), F.col("own").alias("base_own")), "base", "left").withColumn("lent", F.least("cut", F.coalesce("base_own", F.lit(0))))
    at = placed.join(convs.select("c", "first", "cut", "lent"), "c").withColumn("k", F.col("one_to") - F.col("first") + 1)
    at = materialize(at.select("c", "k", "h", "size", "cut", "lent"), "numbered")
    own = at.where("k > cut").select("c", (F.col("lent") + F.col("k") - F.col("cut")).alias("d"), "h", "size")
    heads = at.where(F.col("k") < most).select(F.col("c").alias("base"), "k", "h", "size")
    lent = heads.join(convs.select("c", "base", "cut"), "base").where("k <= cut").select("c", F.col("k").alias("d"), "h", "size")
    n = F.col("lent") + F.greatest(F.col("own") - F.col("cut"), F.lit(0))
    return convs.select("c", n.alias("n")), own.unionByName(lent)


def _paths(steps: DataFrame) -> DataFrame:
    """steps(c, d, h, size) plus ta, tb (the turn's hash with its place), fa, fb (of the sequence up to it), pa, pb (up to the turn before)."""
    salted = lambda k: F.xxhash64(F.lit(k), F.col("d"), F.col("h"))
    x = materialize(steps.select("c", "d", "size", salted(1).alias("ta"), salted(2).alias("tb")), "steps")
    x = running(x, ["c", "d"], xors=("ta", "tb"), name="paths")
    start = x.where("d = 1").select("c", _xor("ta_to", "ta").alias("sa"), _xor("tb_to", "tb").alias("sb"))
    x = x.join(start, "c").select("c", "d", "size", "ta", "tb", _xor("ta_to", "sa").alias("fa"), _xor("tb_to", "sb").alias("fb"))
    return materialize(x.select("*", _xor("fa", "ta").alias("pa"), _xor("fb", "tb").alias("pb")), "prefixes")


def _ranked(whole: DataFrame, paths: DataFrame) -> DataFrame:
    """whole(rep) plus i: its place in lexicographic order. Keys of CHUNK turns are compared; sequences that agree in one go on to the next."""
    turns = F.array_sort(F.collect_list(F.struct("d", "ta", "tb")))  # CHUNK rows at most
    of = paths.join(whole.select(F.col("rep").alias("c")), "c", "left_semi").groupBy(F.col("c").alias("rep"), F.floor((F.col("d") - 1) / CHUNK).alias("m"))
    keys = materialize(of.agg(turns.alias("t")).select("rep", "m", F.flatten(F.transform("t", lambda x: F.array(x["ta"], x["tb"]))).alias("key")), "keys")
    left, out, m = whole.select("rep", F.lit(0).cast("long").alias("at")), None, 0
    while True:
        key = F.coalesce("key", F.array().cast("array<long>"))
        keyed = materialize(left.join(keys.where(F.col("m") == m).select("rep", "key"), "rep", "left").select("rep", "at", key.alias("key")), "keyed")
        groups = running(materialize(keyed.groupBy("at", "key").agg(F.count("*").alias("n")), "groups"), ["at", "key"], ("n",), name="grouped")
        least = groups.groupBy("at").agg(F.min(F.col("n_to") - F.col("n")).alias("least"))
        to = groups.join(least, "at").select("at", "key", "n", (F.col("at") + F.col("n_to") - F.col("n") - F.col("least")).alias("to"))
        moved = materialize(keyed.join(to, ["at", "key"]).select("rep", "to", "n"), "moved")
        done = moved.where("n = 1").select("rep", F.col("to").alias("i"))
        out = done if out is None else out.unionByName(done)
        left, m = moved.where("n > 1").select("rep", F.col("to").alias("at")), m + 1
        if left.isEmpty():
            return out


def _member_digests(members: DataFrame) -> DataFrame:
    """members(n, fa, fb, c) to (n, fa, fb, ends_sha256): of the c of a sequence, ascending, joined by commas.

    The lists are joined in pieces where sorted ranges hold them; the digest then reads the pieces of a list in order, one at a time. SHA-256
    takes its bytes in order, so this last step is one task for a list, over a row for each PIECE members or range.
    """
    key = ["n", "fa", "fb"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            out = []
            for *k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (k != now or len(held) == PIECE):
                    out.append((*now, held[0], ",".join(map(str, held))))
                    held = []
                now = k
                held.append(c)
            if out:
                yield _batch(out)
        if held:
            yield _batch([(*now, held[0], ",".join(map(str, held)))])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            out = []
            for *k, _, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if k == now:
                    h.update(b",")
                else:
                    if now:
                        out.append((*now, h.hexdigest()))
                    now, h = k, hashlib.sha256()
                h.update(text.encode())
            if out:
                yield _batch(out)
        if now:
            yield _batch([(*now, h.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["n", "fa", "fb", "low", "text"] if len(rows[0]) == 5 else ["n", "fa", "fb", "ends_sha256"]
        return pa.RecordBatch.from_pydict({name: list(col) for name, col in zip(names, zip(*rows, strict=True), strict=True)})

    ranges = max(1, -(-members.count() // RANGE_ROWS))
    ordered = members.select(*key, "c").repartitionByRange(ranges, *key, "c").sortWithinPartitions(*key, "c")
    parts = materialize(ordered.mapInArrow(frugal(pieces), "n long, fa long, fb long, low long, text string"), "pieces")
    return parts.repartition(*key).sortWithinPartitions(*key, "low").mapInArrow(frugal(digests), "n long, fa long, fb long, ends_sha256 string")


def prefix_trie(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """convs(c, n), steps(c, d, h, size) to a row for each node: its name (depth, fa, fb), numbers, and its preorder interval (start, stop)."""
    paths = _paths(steps)
    last = paths.groupBy("c").agg(F.max(F.struct("d", "fa", "fb")).alias("l"))
    members = convs.join(last, "c", "left").select("c", "n", F.coalesce("l.fa", F.lit(0)).alias("fa"), F.coalesce("l.fb", F.lit(0)).alias("fb"))
    members = materialize(members, "members")
    whole = materialize(members.groupBy("n", "fa", "fb").agg(F.min("c").alias("rep"), F.count("*").alias("weight")), "whole")
    whole = materialize(_ranked(whole, paths).join(whole.select("rep", "n", "weight"), "rep"), "ranked")
    zero = F.lit(0).cast("long")
    on = paths.join(whole.withColumnRenamed("rep", "c"), "c").select("i", "weight", "c", "n", F.col("d").alias("depth"), "fa", "fb", "pa", "pb", "size")
    top = whole.select("i", "weight", F.col("rep").alias("c"), "n", *[zero.alias(x) for x in ("depth", "fa", "fb", "pa", "pb", "size")])
    most = [F.max(x).alias(x) for x in ("pa", "pb", "size")]
    nodes = on.unionByName(top).groupBy("depth", "fa", "fb").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.sum("weight").alias("n_convs"), F.min("c").alias("conv_id"), (F.max("n") == F.col("depth")).cast("long").alias("leaf"), *most)
    nodes = materialize(nodes.select("*", F.lit(1).cast("long").alias("one"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")), "nodes")
    tour = materialize(running(nodes, ["first", "depth"], ("one", "leaf", "saved"), name="preorder"), "tour")
    stops = tour.groupBy(F.col("first").alias("last")).agg(*[F.max(f"{x}_to").alias(f"{x}_stop") for x in ("one", "leaf", "saved")])
    within = lambda x: F.col(f"{x}_stop") - F.col(f"{x}_to") + F.col(x)
    tour = tour.join(stops, "last").select("depth", "fa", "fb", "pa", "pb", "conv_id", "n_convs", (F.col("one_to") - 1).alias("start"), (F.col("one_stop") - 1).alias("stop"), within("leaf").alias("n_leaves"), within("saved").alias("saved_tokens"))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    ends = _member_digests(members).withColumnRenamed("n", "depth")
    out = tour.join(above, ["depth", "pa", "pb"], "left").join(below, ["depth", "fa", "fb"], "left").join(ends, ["depth", "fa", "fb"], "left")
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_BYTES)).alias("ends_sha256"), "start", "stop")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations, a row for each node.

    Null role and text are empty. Turns without a number come first; turns with one number are in the order of their hash, and
    repeated rows are repeated turns. Rows without conv_id are left out. A conversation without turns ends at the root. An empty table has no root: no
    rows. Very long texts count by their hash and size. Other columns are not read.
    """
    convs, steps = rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie(convs, steps).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP12_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT c, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS own FROM t GROUP BY c),
k AS (SELECT g.*, xor(list_reduce(list_concat([4294967295], [ascii(x)::BIGINT for x in string_split(c::VARCHAR, '')]), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM g, crc),
s AS (SELECT k.c, list_concat(coalesce(b.own, [])[1:k.h], k.own[k.h+1:]) AS s FROM k LEFT JOIN g b ON b.c = k.c - k.c % 5),
p AS (SELECT c, len(s) AS n, s[1:d] AS key, d FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY key, d),
a AS (SELECT key, leaf, (n_convs - 1) * CASE WHEN d > 0 THEN strlen(key[d].t) ELSE 0 END AS saved, unnest(range(0, d + 1)) AS up FROM n),
u AS (SELECT key[1:up] AS key, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY 1),
w AS (SELECT key[1:d-1] AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1)
SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(w.n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN u ON n.key = u.key LEFT JOIN w ON n.key = w.key LEFT JOIN n o ON n.d > 0 AND o.d = n.d - 1 AND o.key = n.key[1:n.d-1]
"""
