"""Cached features: dense image ids, joins with reasons, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import zero_features
from .batches import numbered


def dense_ids(rows: DataFrame, image: str, pos: str, limit: int = 0) -> DataFrame:
    """(image, idx): distinct images numbered by first appearance; limit 0 is none."""
    first = rows.where(F.col(image).isNotNull() & (F.col(image) != "")).groupBy(image).agg(F.min(pos).alias("_first"))
    out = numbered(first, ["_first", image], "idx").drop("_first")
    return out.where(F.col("idx") < limit) if limit else out


def with_reason(records: DataFrame, cache: DataFrame, image: str = "image") -> DataFrame:
    """records plus status: kept, uncached or failed (in this order); records without an image are kept."""
    c = cache.select(F.col("image").alias("_image"), "ok")
    blank = F.col(image).isNull() | (F.col(image) == "")
    x = records.join(c, records[image] == F.col("_image"), "left")
    return x.withColumn("status", F.when(blank, "kept").when(F.col("_image").isNull(), "uncached").when(~F.col("ok"), "failed").otherwise("kept")).drop("_image", "ok")


def reasons(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("kept", "uncached", "failed")])


def with_features(records: DataFrame, cache: DataFrame, image: str = "image", rows: int = 32, width: int = 768) -> DataFrame:
    """Kept records with their features; text-only records get zeros."""
    c = cache.where("ok").select(F.col("image").alias("_image"), "features")
    blank = F.col(image).isNull() | (F.col(image) == "")
    x = records.join(c, records[image] == F.col("_image"), "left").where(blank | F.col("_image").isNotNull())
    return x.withColumn("features", F.coalesce("features", zero_features(rows, width))).drop("_image")


def existing_only(records: DataFrame, listing: DataFrame, image: str = "image") -> DataFrame:
    """Records whose image is listed, and those without an image."""
    blank = F.col(image).isNull() | (F.col(image) == "")
    there = listing.select(F.col("path").alias(image)).distinct()
    return records.where(~blank).join(there, image, "left_semi").unionByName(records.where(blank))


def with_fallback(records: DataFrame, ord_: str = "ord", ok: str = "ok", tries: int = 5) -> DataFrame:
    """records plus used: the place of the first readable record among itself and the next tries - 1, around the end; null if none.

    Places are dense from 0, so a record meets its followers by an equi-join; nothing is sorted in one task.
    """
    n = (records.agg(F.max(ord_).alias("n")).first()["n"] or 0) + 1
    asked = records.select(F.col(ord_).alias("_o"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("_k"))
    asked = asked.withColumn("_at", F.pmod(F.col("_o") + F.col("_k"), F.lit(n)))
    found = asked.join(records.where(F.col(ok)).select(F.col(ord_).alias("_at")), "_at").groupBy("_o").agg(F.min(F.struct("_k", "_at")).alias("m"))
    return records.join(found.select(F.col("_o").alias(ord_), F.col("m._at").alias("used")), ord_, "left")


def failed_images(cache: DataFrame) -> DataFrame:
    return cache.where(~F.col("ok")).select("idx", "image")


def images_of(ids: DataFrame, asked: DataFrame) -> DataFrame:
    """ids(image, idx) read from idx to image: (idx, image) of each asked idx; null where no image has it, the last in order of names where several have."""
    inverse = ids.groupBy("idx").agg(F.max("image").alias("image"))
    return asked.select("idx").distinct().join(inverse, "idx", "left")
