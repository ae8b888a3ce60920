"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are put in a seeded random order; a row's fractional rank is (rank - 1/2) / rows of
its source. Sorting all rows by fractional rank spreads every source evenly, and cutting the sequence
into equal parts gives shards that each hold the corpus's mixture. Counts differ by one at most (`rows`).

Neither a source nor the whole table is ever sorted in one task. A rank is the number of rows in earlier
hash buckets of the source plus the rank inside the bucket; the counts of the buckets are summed up over
two levels (coarse and fine buckets), so no window holds more than about FINE rows of counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Rows of a bucket, about; fine buckets in a coarse one.
BUCKET_ROWS, FINE = 2000, 512
SPAN = 1 << 32


def _offsets(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts(by..., b, n) -> (by..., b, before, total): rows in smaller buckets and in all buckets of the group."""
    hi = F.floor(F.col("b") / FINE).cast("long")
    fine = counts.withColumn("hi", hi)
    coarse = fine.groupBy(*by, "hi").agg(F.sum("n").alias("hi_n"))
    whole = Window.partitionBy(*by)
    coarse = coarse.withColumn("hi_before", F.coalesce(F.sum("hi_n").over(whole.orderBy("hi").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("hi_n").over(whole))
    near = Window.partitionBy(*by, "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("lo_before", F.coalesce(F.sum("n").over(near), F.lit(0)))
    return fine.join(coarse, [*by, "hi"]).select(*by, "b", (F.col("lo_before") + F.col("hi_before")).alias("before"), "total")


def interleave(rows: DataFrame, stratum: str, order: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """rows plus shard (int), slot (long) and frac_rank (double).

    stratum: the source column (null is a source of its own). order: columns that name a row; they seed the
    shuffle and break its ties. Rows that agree in all of them are interchangeable.
    """
    names = rows.columns
    n_rows = rows.count()
    n_buckets = max(1, -(-n_rows // BUCKET_ROWS))
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in order]
    keyed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.when(F.col(f"`{stratum}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string"))).alias("s"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), *text)).alias("h"),
    ).withColumn("b", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(n_buckets) / SPAN).cast("long"))
    tie = [F.col(f"row.`{c}`") for c in order]
    # the rank inside a source
    offsets = _offsets(keyed.groupBy("s", "b").agg(F.count("*").alias("n")), ["s"])
    inside = F.row_number().over(Window.partitionBy("s", "b").orderBy("h", *tie))
    ranked = keyed.withColumn("inside", inside).join(offsets, ["s", "b"])
    frac = (2 * (F.col("before") + F.col("inside")) - 1) / (2 * F.col("total"))
    ranked = ranked.select("row", "s", "h", frac.alias("f")).withColumn("b", F.least(F.floor(F.col("f") * n_buckets), F.lit(n_buckets - 1)).cast("long"))
    # the place among all rows
    offsets = _offsets(ranked.groupBy("b").agg(F.count("*").alias("n")).withColumn("g", F.lit(0)), ["g"]).drop("g", "total")
    inside = F.row_number().over(Window.partitionBy("b").orderBy("f", "s", "h", *tie))
    placed = ranked.withColumn("inside", inside).join(offsets, "b").withColumn("at", F.col("before") + F.col("inside") - 1)
    # exact integer arithmetic: shard is the largest k with ceil(k * n / shards) <= at
    shard = F.expr(f"(at * {n_shards}L) div {max(1, n_rows)}L")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"at - (shard * {n_rows}L + {n_shards - 1}L) div {n_shards}L")).select("row.*", "shard", "slot", F.col("f").alias("frac_rank"))


def op10_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 40) -> DataFrame:
    """All documents into shards 0 to 39 by law `rows`.

    Null text: 0 bytes, CRC of no bytes (0). Null source: a source of its own. Repeated rows each get a slot.
    An empty table gives no rows. Columns beside doc_id, text and source are not read.
    """
    d = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = d.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), "source")
    out = interleave(rows, "source", ["doc_id", "text_crc32", "size"], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "frac_rank")


#: The CRC by its table of 256 entries, made by rule.
OP10_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
x AS (SELECT doc_id, source, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, source, strlen(t)::BIGINT + 16 AS size,
  xor(list_reduce(list_concat([4294967295], [('0x' || substr(x, 2 * i + 1, 2))::BIGINT for i in range(strlen(t))]), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM x, crc),
k AS (SELECT *, coalesce('=' || source, '') AS s, md5(concat('0|', coalesce(doc_id::VARCHAR, ''), '|', text_crc32, '|', size)) AS h, count(*) OVER () AS n FROM c),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY s ORDER BY h, doc_id, text_crc32, size) - 1) / (2 * count(*) OVER (PARTITION BY s))::DOUBLE AS frac_rank FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY frac_rank, s, h, doc_id, text_crc32, size) - 1 AS i FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, (i * 40 // n)::INTEGER AS shard, i - ((i * 40 // n) * n + 39) // 40 AS slot, NULL::INTEGER AS grown_shard, source, frac_rank FROM p
"""
