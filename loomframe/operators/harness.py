"""One backend in runs of different batch sizes: rows, errors and seconds are observed while the replies are written.

A run is one pass; what it took is measured where the backend is called and is added up by the engine as rows stream by, so the
figures cost no second pass. Sizes are tried in turn, until one fails.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.text import ERROR
from ..sources.shared import fresh_path
from .inference import Backend

#: A row for each size that was tried.
REPORT = "batch_size int, n_frames long, n_errors long, time_s double, wall_s double, frames_per_s double, error string"


def timed(rows: DataFrame, make: Callable[[], Backend], batch_size: int, name: str = "reply") -> DataFrame:
    """rows plus the reply, or the error marker, and seconds: the row's share of its batch's time in the backend."""
    schema = StructType([*rows.schema, StructField(name, StringType()), StructField("seconds", DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for x in frames:
            for i in range(0, len(x), batch_size):
                part = x.iloc[i : i + batch_size]
                began = time.perf_counter()
                try:
                    replies = backend.reply(part)
                except Exception as e:  # noqa: BLE001  the error is the rows' result
                    replies = [f"{ERROR}: {type(e).__name__}: {e}"] * len(part)
                yield part.assign(**{name: replies, "seconds": (time.perf_counter() - began) / len(part)})

    return rows.mapInPandas(run, schema)


def run_size(rows: DataFrame, make: Callable[[], Backend], batch_size: int, out: str) -> dict:
    """Write the replies of one run to out; what it took."""
    failed = F.col("reply").startswith(ERROR)
    seen = Observation(f"batch size {batch_size}")
    observed = timed(rows, make, batch_size).observe(seen, F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.sum("seconds").alias("seconds"), F.max(F.when(failed, F.col("reply"))).alias("error"))
    began = time.perf_counter()
    observed.drop("seconds").withColumn("run", F.lit(f"bs={batch_size}")).write.mode("overwrite").parquet(out)
    got, wall = seen.get, time.perf_counter() - began
    seconds = got["seconds"] or 0.0
    return {"batch_size": batch_size, "n_frames": got["n"], "n_errors": got["errors"], "time_s": seconds, "wall_s": wall, "frames_per_s": got["n"] / seconds if seconds else None, "error": got["error"]}


def sweep(rows: DataFrame, make: Callable[[], Backend], sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """(report, replies): a row for each size up to the first that fails, and the replies of the sizes that did not, as (..., reply, run).

    Replies are joined with other runs by key, never by position. time_s is the backend's, over all tasks; wall_s the run's.
    """
    spark = rows.sparkSession
    report, paths = [], []
    for size in sizes:
        path = fresh_path(spark, f"replies-{size}")
        report.append(run_size(rows, make, size, path))
        if report[-1]["n_errors"]:
            break
        paths.append(path)
    names = [f.split()[0] for f in REPORT.split(", ")]
    columns = StructType([*rows.schema, StructField("reply", StringType()), StructField("run", StringType())])
    replies = spark.read.schema(columns).parquet(*paths) if paths else spark.createDataFrame([], columns)
    return spark.createDataFrame([tuple(r[c] for c in names) for r in report], REPORT), replies
