"""Readers of JSON, JSON lines, media listings and feature tables. Schemas are given, never inferred."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.numbers import frame_times
from ..functions.text import file_stem, frame_name, parent_name
from . import schemas


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines; a line that cannot be read fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_done(spark: SparkSession, path: str, schema: str, key: str = "frame_path") -> DataFrame:
    """JSON lines of an earlier run: broken lines and lines without the key are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())


def read_tagged(spark: SparkSession, paths: dict[str, str], schema: str, column: str = "split_source") -> DataFrame:
    """JSON lines of several files (tag to path), each row with its tag."""
    parts = [read_lines(spark, path, schema).withColumn(column, F.lit(tag)) for tag, path in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Split files, one JSON array each: R1 with the split's name and ord, the place by which the last entry of an id wins."""
    parts = [read_array(spark, path, schemas.SPLIT).withColumn("split", F.lit(name)).withColumn("ord", F.lit(i)) for i, (name, path) in enumerate(paths.items())]
    return reduce(DataFrame.unionByName, parts)


def list_videos(spark: SparkSession, folders: list[str], pattern: str = "*.mp4", limit: int = 0) -> DataFrame:
    """(batch, batch_ord, path, video_id) of files in folders, names in order within each; limit counts by folder, 0 is none."""
    from pyspark.sql import Window

    parts = [spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f).select("path").withColumn("batch_ord", F.lit(i)) for i, f in enumerate(folders)]
    out = reduce(DataFrame.unionByName, parts).select(parent_name(F.col("path")).alias("batch"), "batch_ord", "path", file_stem(F.col("path")).alias("video_id"))
    if limit:
        rank = F.row_number().over(Window.partitionBy("batch_ord").orderBy("path"))
        out = out.withColumn("k", rank).where(F.col("k") <= limit).drop("k")
    return out


def probe_duration(path: str) -> float:
    """Seconds of a video by ffprobe; 0 where it cannot be read."""
    try:
        out = subprocess.run(["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "default=noprint_wrappers=1:nokey=1", path], capture_output=True, text=True, timeout=60)
        return float(out.stdout.strip())
    except (OSError, ValueError, subprocess.SubprocessError):
        return 0.0


@F.pandas_udf(DoubleType())
def duration_of(path: pd.Series) -> pd.Series:
    return path.map(lambda p: probe_duration(p.removeprefix("file:")))


def plan_frames(videos: DataFrame, most: int = 30) -> DataFrame:
    """videos(video_id, path, duration) to one row a frame: time_s and file name."""
    at = videos.select("*", F.explode(frame_times(F.col("duration"), most)).alias("time_s"))
    return at.withColumn("time_s", F.bround("time_s", 2)).withColumn("frame_name", frame_name(F.col("video_id"), F.col("time_s")))


def extract_frames(planned: DataFrame, out_dir: str) -> DataFrame:
    """One JPEG for each planned row (ffmpeg, external); files that are there and not empty are kept. Adds frame_path, null if it failed."""
    schema = StructType([*planned.schema, StructField("frame_path", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for x in batches:
            made = []
            for path, t, video, name in zip(x["path"], x["time_s"], x["video_id"], x["frame_name"], strict=True):
                target = os.path.join(out_dir, video, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                if not (os.path.exists(target) and os.path.getsize(target)):
                    try:
                        subprocess.run(["ffmpeg", "-y", "-loglevel", "error", "-ss", str(t), "-i", path.removeprefix("file:"), "-frames:v", "1", target], timeout=120, check=False)
                    except (OSError, subprocess.SubprocessError):
                        pass
                made.append(target if os.path.exists(target) and os.path.getsize(target) else None)
            yield x.assign(frame_path=made)

    return planned.mapInPandas(run, schema)


def extraction_counts(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """One row: videos, frames, and videos without a frame."""
    n = frames.where(F.col("frame_path").isNotNull()).groupBy("video_id").agg(F.count("*").alias("n"))
    each = videos.select("video_id").join(n, "video_id", "left")
    return each.agg(F.count("*").alias("videos"), F.coalesce(F.sum("n"), F.lit(0)).alias("frames"), F.count_if(F.col("n").isNull()).alias("failed"))


def read_images(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, content) of files that are not empty."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).where("length > 0").select("path", "content")


def read_features(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """The feature table, after a check of its one-row meta table's dtype."""
    meta = spark.read.schema(schemas.FEATURES_META).parquet(f"{path}/meta").select("dtype").first()
    if meta is None or meta["dtype"] != dtype:
        raise ValueError(f"the features are {meta and meta['dtype']}, not {dtype}")
    return spark.read.schema(schemas.FEATURES).parquet(f"{path}/features")


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    """(idx) of images whose features could not be made."""
    return spark.read.schema(schemas.FEATURES_FAILED).parquet(f"{path}/failed")
