"""Token ids to rows of features: an embedding row for each id, the image's rows at its sentinel, batches padded with zero rows.

Ids are exploded with their places and joined with the embedding table; common ids are hot keys. A table whose size is checked and small is
broadcast; a larger one is joined in salted shares: each of its rows is repeated for each share, and each place goes to one share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import IGNORE, IMAGE_TOKEN

#: Bytes of an embedding table that is broadcast, at most; shares of a larger one.
BROADCAST_BYTES, SHARES = 32 << 20, 16


def token_rows(places: DataFrame, table: DataFrame, width: int, limit: int = BROADCAST_BYTES, shares: int = SHARES) -> DataFrame:
    """places(..., id) plus row: the embedding of the id by table(id, vector), null where the table has none (or id is null)."""
    rows = table.select(F.col("id").alias("_id"), F.col("vector").alias("row")).dropDuplicates(["_id"])
    if table.count() * width * 4 <= limit:
        return places.join(F.broadcast(rows), F.col("id") == F.col("_id"), "left").drop("_id")
    spread = rows.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    salted = places.withColumn("_s", F.pmod(F.xxhash64(*places.columns), F.lit(shares)).cast("int"))
    return salted.join(spread.hint("merge"), (F.col("id") == F.col("_id")) & (F.col("_s") == F.col("_share")), "left").drop("_id", "_s", "_share")


def zero_row(width: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), width)


def spliced(samples: DataFrame, table: DataFrame, images: DataFrame, key: str, width: int, queries: int, **join: int) -> DataFrame:
    """samples(key, input_ids, labels), images(key, features) to (key, rows, labels): `queries` rows at the sentinel.

    A sample holds one sentinel at most; a second is an error. An image without features has zero rows, as has an id that the table lacks.
    Longer features are cut, shorter ones end in zero rows. A sample without ids has no rows. Samples are of bounded length (they were truncated), so one is regrouped in
    one row; keys are unique.
    """
    samples, images = samples.select(F.col(key).alias("_key"), "input_ids", "labels"), images.select(F.col(key).alias("_key"), "features")
    both = F.posexplode(F.arrays_zip(F.col("input_ids").alias("i"), F.col("labels").alias("l"))).alias("at", "x")
    places = samples.select("_key", both).select("_key", "at", F.col("x.i").alias("id"), F.col("x.l").alias("label"))
    text = token_rows(places.where((F.col("id") != IMAGE_TOKEN) | F.col("id").isNull()), table, width, **join)
    text = text.select("_key", "at", F.lit(0).alias("k"), F.coalesce("row", zero_row(width)).alias("row"), "label")
    marks = places.where(F.col("id") == IMAGE_TOKEN).groupBy("_key").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    marks = marks.withColumn("at", F.when(F.col("n") > 1, F.raise_error(F.lit("more than one image in a sample"))).otherwise(F.col("at")).cast("int"))
    shown = marks.join(images, "_key", "left").select("_key", "at", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))).alias("k"), "features")
    shown = shown.select("_key", "at", "k", F.coalesce(F.get("features", F.col("k")), zero_row(width)).alias("row"), F.lit(IGNORE).cast("long").alias("label"))
    parts = F.array_sort(F.collect_list(F.struct("at", "k", "row", "label")))
    whole = text.unionByName(shown).groupBy("_key").agg(parts.alias("p")).select("_key", F.transform("p", lambda x: x["row"]).alias("rows"), F.transform("p", lambda x: x["label"]).alias("labels"))
    empty = samples.where((F.size("input_ids") <= 0) | F.col("input_ids").isNull()).select("_key", F.array().cast("array<array<float>>").alias("rows"), F.array().cast("array<long>").alias("labels"))
    return whole.unionByName(empty).withColumnRenamed("_key", key)


def padded_rows(samples: DataFrame, batch: str, width: int) -> DataFrame:
    """samples(batch, rows, labels) with rows and labels as long as the batch's longest, batch_len, and the attention mask.

    The longest is found from lengths alone; rows do not move.
    """
    n = F.size("rows")
    longest = samples.groupBy(batch).agg(F.max(n).alias("batch_len"))
    x = samples.join(longest, batch)
    more = F.col("batch_len") - n
    repeat = lambda value, times: F.array_repeat(value, times)
    mask = F.concat(repeat(F.lit(1).cast("long"), n), repeat(F.lit(0).cast("long"), more))
    return x.withColumns({"rows": F.concat("rows", repeat(zero_row(width), more)), "labels": F.concat("labels", repeat(F.lit(IGNORE).cast("long"), more)), "attention_mask": mask})
