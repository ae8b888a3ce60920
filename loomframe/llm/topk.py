"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of about BLOCK rows, queries into blocks of QUERY_BLOCK; every pair of blocks is
one bounded group (a stated query set against all rows, in blocks). In a group each dimension has a list sorted by
value. For a query the lists are read from the end that its weight favours, depth by depth; each row that turns up is
scored in full; once the k-th best score is above what any unseen row can reach (the weights times the values at
the present depth), the block is done. A strict comparison keeps ties whole. The blocks' winners are merged by query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Candidates and queries of a block, about.
BLOCK, QUERY_BLOCK = 4096, 512


def quantise(v: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; one that 64 bits cannot hold is an error."""

    def one(x: Column) -> Column:
        y = F.lit(float(factor)) * x.cast("double")
        return F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error(F.lit("a component is too large for a whole number of 64 bits")).cast("long"))

    return F.transform(v, one)


def usable(v: Column) -> Column:
    """Not null, and all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


class Lists:
    """A block's rows and, for each dimension, their order by value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.real = self.rows.astype(np.float64)
        self.limit = float(np.abs(self.real).max(initial=0))
        self.up = np.argsort(self.rows, axis=0, kind="stable")

    def top(self, q: np.ndarray, k: int, own: int, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows but those with id own; score descending, id ascending.

        Scores that 64 bits may not hold are reckoned in Python's integers; one among the best that they do not hold is an error.
        """
        n, d = self.rows.shape
        reach = self.limit * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(d, 1)
        kind = np.float64 if reach < 2**53 else np.int64 if reach < 2**62 else object
        whole = object if kind is object else np.int64
        rows, w = self.real if kind is np.float64 else self.rows.astype(kind), q.astype(kind)
        low, high = np.flatnonzero(q < 0), np.flatnonzero(q > 0)
        seen = np.zeros(n, bool)
        best_s, best_i = np.zeros(0, whole), np.zeros(0, np.int64)
        at = 0
        while at < n:
            to = min(n, at + step)
            met = np.zeros(n, bool)
            if len(low) + len(high):
                met[self.up[at:to, low].ravel()] = True
                met[self.up[n - to : n - at, high].ravel()] = True
            else:  # every score is 0: rows in the order of their ids
                met[at:to] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            new = new[self.ids[new] != own]
            if len(new):
                score = (rows[new] @ w).astype(whole)
                if len(best_s) >= k:
                    good = score >= best_s[-1]
                    new, score = new[good], score[good]
                s, i = np.concatenate([best_s, score]), np.concatenate([best_i, self.ids[new]])
                keep = np.lexsort((i, -np.unique(s, return_inverse=True)[1]))[:k]
                best_s, best_i = s[keep], i[keep]
            edge = n - to
            ahead = self.rows[self.up[to - 1, low], low], self.rows[self.up[edge, high], high]
            bound = int(sum((x.astype(whole) * q[at_].astype(whole)).sum() for x, at_ in zip(ahead, (low, high), strict=True)))
            if len(best_s) >= k and (best_s[-1] > bound or best_s[-1] == bound and not len(low) + len(high)) or seen.all():
                break
            at, step = to, step * 2
        if whole is object and any(not -(2**63) <= x < 2**63 for x in best_s):
            raise ValueError("a score is too large for a whole number of 64 bits")
        return best_s.astype(np.int64), best_i


def top_k(candidates: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """candidates(vec_id, v array<long>), queries(query_id, v): (query_id, rank, vec_id, score).

    Rows whose vec_id is the query's are its own and left out; a query_id given twice counts once (its smallest
    vector). Vectors are compared only with those of as many components.
    """
    queries = queries.groupBy("query_id").agg(F.min("v").alias("v"))
    n, m = candidates.count(), queries.count()
    c_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    deal = lambda id_, blocks: F.pmod(F.xxhash64(id_, "v"), F.lit(blocks)).cast("int")
    c = candidates.select("vec_id", "v", F.size("v").alias("dim"), deal("vec_id", c_blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    q = queries.select("query_id", "v", F.size("v").alias("dim"), deal("query_id", q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            lists = Lists(left["vec_id"].to_numpy(np.int64), np.stack(left["v"].to_numpy()).astype(np.int64))
            for query_id, v in zip(right["query_id"], right["v"], strict=True):
                s, i = lists.top(np.asarray(v, np.int64), k, int(query_id))
                out.append(pd.DataFrame({"query_id": np.full(len(s), query_id, np.int64), "vec_id": i, "score": s}))
        return pd.concat(out) if out else pd.DataFrame({x: np.zeros(0, np.int64) for x in ("query_id", "vec_id", "score")})

    by = ["qb", "cb", "dim"]
    found = c.groupBy(*by).cogroup(q.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for each vec_id divisible by 50. Null ids take no part.

    Vectors that are null or hold null or non-finite components take no part; an empty table gives no rows. Ties go to the
    smaller vec_id; a candidate given twice is found twice, a query given twice asks once. Vectors of other lengths are not
    compared. A component or a winning score beyond 64 bits is an error, never a wrapped number.
    """
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    e = e.select("vec_id", quantise(F.col("embedding")).alias("v"))
    return top_k(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), 5)


OP4_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
