"""Reproducible choice of rows: independent of row order and of the number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def sample_by_group(rows: DataFrame, group: str, key: str, k: int, seed: str = "42") -> DataFrame:
    """k rows of each group, in the order of seeded hashes. Ranks are cut before the shuffle, so a large group costs k rows a task."""
    w = Window.partitionBy(group).orderBy(sample_order(F.col(key), seed), key)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def sample_excluding(rows: DataFrame, done: DataFrame, group: str, key: str, k: int, total: int, seed: str = "42") -> DataFrame:
    """As above, then without rows that are done, then the first `total` by group and hash."""
    picked = sample_by_group(rows, group, key, k, seed).join(done.select(key), key, "left_anti")
    return picked.orderBy(group, sample_order(F.col(key), seed), key).limit(total)


def limit_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n in order; 0 is all."""
    return rows.orderBy(*order).limit(n) if n else rows


def with_split(rows: DataFrame, splits: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows of videos that a split names, with that split in place of their own."""
    return rows.drop("split").join(splits.select(key, "split"), key)
