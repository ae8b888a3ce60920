"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark contamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm.common import fresh_path
from loomframe.llm.decontaminate import drop_contaminated
from loomframe.llm.minhash import drop_near_duplicates
from loomframe.llm.pieces import encode_stage
from loomframe.llm.repeats import drop_repeats
from loomframe.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeats),
    ("decontamination", drop_contaminated),
    ("token_ids", encode_stage),
]

#: The first stage fits trees, which SQL cannot; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
