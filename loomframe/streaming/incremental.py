"""Incremental runs: a stream over a folder, a checkpoint in place of a resume flag, each key written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.labels import not_done
from ..sources.files import read_done


def stream_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def run_incrementally(rows: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "frame_path", available_now: bool = True) -> StreamingQuery:
    """Apply work to rows whose key is not yet in out, batch by batch, and append the results.

    A batch that is replayed after a failure finds its rows done, so nothing is written twice.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates([key])
        try:
            batch = not_done(batch, read_done(spark, out, f"{key} string", key), key)
        except Exception as e:  # the first batch: nothing is written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        work(batch).write.mode("append").json(out)

    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
