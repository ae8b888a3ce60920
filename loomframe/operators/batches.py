"""Batches of samples: places, batch ids, padding, length groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import IGNORE, attention_mask, pad, pad_left
from ..sources.shared import materialize


def numbered(rows: DataFrame, order: list[str], name: str = "ord", rows_per_part: int = 1_000_000) -> DataFrame:
    """rows plus their place in a total order, from 0: one range shuffle, no task sorts more than a range.

    The sorted ranges are written once to the shared folder, so that counts and places come from the same ranges. A row's place
    is its number within its range plus the rows of earlier ranges; the ranges' counts, one row each, are broadcast
    (a row for each rows_per_part rows). Rows that agree in the whole order have places in no stated order.
    """
    parts = max(1, -(-rows.count() // rows_per_part))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "numbered")
    part = F.shiftright("id", 33)
    counts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("part", part).join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    return placed.select("row.*", (F.col("id") - F.shiftleft("part", 33) + F.col("before")).alias(name))


def numbered_within(rows: DataFrame, group: str, order: list[str], name: str = "place", rows_per_part: int = 1_000_000) -> DataFrame:
    """rows plus their place in the order within their group, from 1; a large group is spread over ranges like any other rows."""
    placed = numbered(rows, [group, *order], "_ord", rows_per_part)
    first = placed.groupBy(group).agg(F.min("_ord").alias("_first"))
    placed, first = placed.alias("p"), first.withColumnRenamed(group, "_group")
    return placed.join(first, F.col(f"p.`{group}`").eqNullSafe(F.col("_group"))).withColumn(name, F.col("_ord") - F.col("_first") + 1).select(*rows.columns, name)


def with_batch(rows: DataFrame, size: int, ord_: str = "ord", name: str = "batch_id") -> DataFrame:
    """The batch of each place; the last one may be short."""
    return rows.withColumn(name, F.floor(F.col(ord_) / size).cast("long"))


def padded(rows: DataFrame, batch: str, pad_id: int) -> DataFrame:
    """rows(batch, input_ids, labels) with all arrays as long as the batch's longest, and the attention mask."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    x = rows.withColumn("batch_len", longest)
    mask = attention_mask(F.col("input_ids"), F.col("batch_len"))
    return x.withColumns({"input_ids": pad(F.col("input_ids"), F.col("batch_len"), pad_id), "labels": pad(F.col("labels"), F.col("batch_len"), IGNORE), "attention_mask": mask})


def left_padded(rows: DataFrame, batch: str, pad_id: int) -> DataFrame:
    """rows(batch, input_ids, attention_mask, labels) of prompts, as long as the batch's longest, padded at the left. A null prompt is empty."""
    arrays = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORE}
    x = rows.withColumns({c: F.coalesce(c, F.array().cast("array<long>")) for c in arrays})
    x = x.join(x.groupBy(batch).agg(F.max(F.size("input_ids")).alias("batch_len")), batch)
    return x.withColumns({c: pad_left(F.col(c), F.col("batch_len"), value) for c, value in arrays.items()})


def collated(rows: DataFrame, batch: str, order: str) -> DataFrame:
    """One row a batch: rectangular arrays of arrays, in order (a batch is of bounded size)."""
    parts = F.array_sort(F.collect_list(F.struct(order, "input_ids", "labels", "attention_mask")))
    g = rows.groupBy(batch).agg(parts.alias("p"))
    column = lambda c: F.transform("p", lambda r: r[c]).alias(c)
    return g.select(batch, *[column(c) for c in ("input_ids", "labels", "attention_mask")])


def length_groups(rows: DataFrame, key: str, length: str, mega: int, seed: str = "42") -> DataFrame:
    """Rows in seeded groups of about `mega`, within each by falling length: mega_id and place."""
    n = max(1, -(-rows.count() // mega))
    of = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n))
    x = rows.withColumn("mega_id", of)
    return x.withColumn("place", F.row_number().over(Window.partitionBy("mega_id").orderBy(F.desc(length), key)) - 1)
