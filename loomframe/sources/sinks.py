"""Writers: JSON lines, arrays, one summary file, features; append only with a resume."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.labels import not_done


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_new(df: DataFrame, path: str, done: DataFrame | None, key: str = "frame_path") -> DataFrame:
    """Append the rows whose key is not done, or write anew where nothing is; returns what was asked for."""
    fresh = df if done is None else not_done(df, done, key)
    fresh.write.mode("overwrite" if done is None else "append").json(path)
    return fresh


def write_by(df: DataFrame, path: str, column: str) -> None:
    """A folder of JSON lines for each value."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def as_array(df: DataFrame, order: list[str]) -> DataFrame:
    """One row with one JSON array of all rows in order; only for results that fit a task (a split's export)."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*df.columns)).alias("_json"))))
    return df.agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["_json"]), ", "), F.lit("]")).alias("value"))


def summary_text(df: DataFrame) -> str:
    """A one-row summary as indented JSON."""
    return json.dumps(json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]), indent=2, ensure_ascii=False)


def keyed_by_text(df: DataFrame, key: str) -> DataFrame:
    """One row: a map from the key, as text, to the other columns (reports of a few rows)."""
    rest = [c for c in df.columns if c != key]
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.struct(*rest))))).alias("by_key"))


def write_buckets(features: DataFrame, path: str, name: str, buckets: int, key: str = "image") -> None:
    """features as a table dealt by key: joins on key use its buckets, and only the other side is shuffled."""
    features.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def write_features(features: DataFrame, path: str, dtype: str, queries: int, width: int, bundle: str, force: bool = False) -> None:
    """features(image, idx, ok, features), the idx of those that failed as a table, and a meta row with counts; refuses to replace a table unless forced."""
    mode = "overwrite" if force else "errorifexists"
    features.write.mode(mode).parquet(f"{path}/features")
    features.where(~F.col("ok")).select("idx").write.mode(mode).parquet(f"{path}/failed")
    meta = features.agg(F.lit(queries).alias("num_query_tokens"), F.lit(width).alias("hidden_size"), F.lit(dtype).alias("dtype"), F.count("*").alias("count"), F.count_if(~F.col("ok")).alias("failed"), F.lit(bundle).alias("bundle"))
    meta.write.mode(mode).parquet(f"{path}/meta")
