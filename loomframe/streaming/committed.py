"""Appends that count once: a folder of batches and a log of those that are whole.

A batch is written to its own folder, which a replay overwrites, and is entered in the log by renaming one small file, which
either happens or does not. Readers take the batches of the log only. Keys that were seen are a stream's state, kept with the
output in its checkpoint; so a batch costs its own rows, however much was written before.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _entry(out: str, batch: int) -> str:
    return f"{out}/log/{batch:012d}.json"


def commit(rows: DataFrame, batch: int, out: str, before_entry: Callable[[], None] | None = None) -> bool:
    """Write a batch's rows and enter it in the log; False if it is there already (then nothing is written).

    before_entry is called between the two, for tests of a failure there.
    """
    spark = rows.sparkSession
    fs, entry = _file_system(spark, _entry(out, batch))
    if fs.exists(entry):
        return False
    data = f"data/batch={batch}"
    rows.write.mode("overwrite").parquet(f"{out}/{data}")
    if before_entry:
        before_entry()
    _, draft = _file_system(spark, f"{out}/log/_draft-{batch:012d}")  # its name hides it from readers
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps({"batch": batch, "data": data}).encode()))
    stream.close()
    if not fs.rename(draft, entry) and not fs.exists(entry):
        raise OSError(f"batch {batch} could not be entered in the log of {out}")
    return True


def read_committed(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows of the batches in the log, with their batch; no rows where nothing is written."""
    fs, log = _file_system(spark, f"{out}/log")
    named = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    batches = sorted(int(n.removesuffix(".json")) for n in named if n[0] != "_" and n.endswith(".json"))
    if not batches:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{out}/data").parquet(*[f"{out}/data/batch={b}" for b in batches])


def append_once(rows: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, key: str, before_entry: Callable[[int], None] | None = None) -> StreamingQuery:
    """Apply work to the rows of a stream whose key was not seen, and append the results to out; each key counts once.

    The checkpoint lies in out and belongs to it. A batch that failed is replayed from the same rows and the same state of keys.
    Rows without a key are one key. With very many keys use the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """

    def step(batch: DataFrame, number: int) -> None:
        commit(work(batch), number, out, before_entry and (lambda: before_entry(number)))

    return rows.dropDuplicates([key]).writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
