"""JSON arrays of any size: part files that are one array when put together in the order of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import numbered


def write_array(df: DataFrame, path: str, order: list[str], rows_per_part: int = 1_000_000) -> None:
    """All rows, in order, as one JSON array in part files under path; no task holds more than a part.

    The first row has the opening bracket before it, others a comma, the last the closing bracket behind it. No rows give `[]`.
    """
    rows = numbered(df.select(*order, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_json")), order, "_at", rows_per_part)
    last = rows.agg(F.max("_at").alias("m")).first()["m"]
    if last is None:
        df.sparkSession.createDataFrame([("[]",)], "value string").write.text(path)
        return
    line = F.concat(F.when(F.col("_at") == 0, "[").otherwise(","), F.col("_json"), F.when(F.col("_at") == last, "]").otherwise(""))
    parts = -(-(last + 1) // rows_per_part)
    rows.repartitionByRange(parts, "_at").sortWithinPartitions("_at").select(line.alias("value")).write.text(path)


def read_array_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of such an array; lines are read where they lie, and a line that is no object of the schema fails the query."""
    body = F.regexp_replace(F.regexp_replace("value", r"^[\[,]", ""), r"\]$", "")
    return spark.read.text(path).where("value <> '[]'").select(F.from_json(body, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
