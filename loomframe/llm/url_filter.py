"""URL rules behind a Bloom filter cascade, in DataFrame operations only.

A rule is `host/path-prefix`. A url's probe keys are its host suffixes joined with its path prefixes, of the
label counts and lengths that occur among the rules; the key universe is every probe key of the corpus. Level 1
of the cascade encodes the listed keys (the rules), level 2 the universe's keys that level 1 passes by mistake,
level 3 the listed keys that level 2 passes, and so on until a level makes no mistake. The first level that
says no decides: exact for every key of the universe, with no join at query time. The longest key that the
cascade holds is the url's rule; urls without one are not listed, and allowed.

Filters sit in the plan as literals. Level 1 has about 1.44 log2(universe / list) bits for each listed key, later
levels 1.44 bits for each key they encode, so their size follows the list, not the corpus; `max_bits` checks it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: The rules of the contract, (verdict, pattern).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def probe_keys(host: Column, path: Column, patterns: list[str]) -> Column:
    """array<string>: each host suffix with each path prefix that could be a rule; shapes without a rule are left out."""
    shapes = sorted({(p.partition("/")[0].count(".") + 1, len(p) - p.index("/")) for p in patterns})
    labels = F.split(host, r"\.", -1)

    def key(n: int, m: int) -> Column:
        suffix = F.array_join(F.slice(labels, -n, n), ".")
        return F.when((F.size(labels) >= n) & (F.length(path) >= m), F.concat(suffix, F.substring(path, 1, m)))

    return F.array_distinct(F.array_compact(F.array(*[key(n, m) for n, m in shapes])))


class Cascade:
    """Levels of Bloom filters; `holds(key)` is exact for keys of the universe it was built over.

    A list too long for levels of max_bits bits is split by hash into parts, each with a cascade of its own.
    """

    def __init__(self, depth: int = 0):
        self.levels: list[tuple[list[int], int, int]] = []
        self.parts: list[Cascade] = []
        self.depth = depth

    def _part(self, key: Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(f"part {self.depth}"), key), F.lit(parts))

    def _bits(self, key: Column, level: int, k: int, m: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(f"{level}.{i}"), key), F.lit(m)) for i in range(k)]

    def _passes(self, key: Column, level: int) -> Column:
        words, k, m = self.levels[level]
        held = F.lit(words).cast("array<bigint>")
        return reduce(lambda a, b: a & b, [F.getbit(F.element_at(held, (F.shiftright(p, 6) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in self._bits(key, level, k, m)])

    def _add(self, keys: DataFrame, n: int, rate: float) -> None:
        """keys(key): a further level that encodes them with false positives at the given rate."""
        m = max(64, self._size(n, rate))
        k, m, level = max(1, round(-math.log2(rate))), -(-m // 64) * 64, len(self.levels)
        bit = keys.select(F.explode(F.array(*self._bits(F.col("key"), level, k, m))).alias("p"))
        words = bit.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("v"))
        held = [0] * (m // 64)
        for row in words.collect():  # at most m / 64 rows
            held[row["w"]] = row["v"]
        self.levels.append((held, k, m))

    @staticmethod
    def _size(n: int, rate: float) -> int:
        return math.ceil(n * -math.log(rate) / math.log(2) ** 2)

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, max_bits: int = 1 << 23, depth: int = 0) -> Cascade:
        """listed(key) and universe(key), both distinct and without nulls; the list may hold keys outside the universe."""
        self = cls(depth)
        n = listed.count()
        if not n:
            return self
        size = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
        yes, no = listed, None
        rate = min(0.5, n * math.sqrt(0.5) / max(1, size))
        if n > 1 and (parts := -(-cls._size(n, rate) // max_bits)) > 1:
            own = lambda keys, p: keys.where(self._part(F.col("key"), parts) == p)
            # parts are of unequal size: half as much again is allowed, and those still too large split further by another hash
            self.parts = [cls.build(own(listed, p), own(universe, p), max_bits + max_bits // 2, depth + 1) for p in range(parts)]
            return self
        self._add(yes, n, rate)
        while True:
            level = len(self.levels) - 1
            if no is None:
                no = universe.where(self._passes(F.col("key"), level)).join(listed, "key", "left_anti")
                wrong, other = no, yes
            else:
                wrong = other.where(self._passes(F.col("key"), level))
                no, other = wrong, no
            count = wrong.count()
            if not count:
                return self
            self._add(wrong, count, 0.5)

    def holds(self, key: Column) -> Column:
        """Levels that pass in turn: a no at an even place (the first, the third ...) means not listed."""
        if self.parts:
            part = self._part(key, len(self.parts))
            return reduce(lambda out, p: F.when(part == p[0], p[1].holds(key)).otherwise(out), enumerate(self.parts), F.lit(False))
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """pages plus host, path, rule and verdict. Null urls and urls without `://`: empty host and path, no rule."""
    spark = pages.sparkSession
    patterns = [p for _, p in rules]
    host, path = host_path(F.col("url"))
    parts = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    keys = probe_keys(F.col("host"), F.col("path"), patterns)
    universe = parts.select(F.explode(keys).alias("key")).distinct()
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in patterns])).alias("key")).distinct() if patterns else spark.range(0).select(F.lit("").alias("key"))
    cascade = Cascade.build(listed, universe)
    held = F.filter(keys, lambda k: cascade.holds(k))
    longest = F.reduce(held, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    verdicts = F.lit(default)
    for verdict, pattern in rules:
        verdicts = F.when(F.col("rule") == pattern, verdict).otherwise(verdicts)
    return parts.withColumn("rule", longest).withColumn("verdict", verdicts)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under RULES; urls that no rule fits are unlisted keys of the cascade: allow.

    Null urls and urls without `://`: empty host and path, no rule, allow. Very long urls and repeated rows are rows like others;
    null and repeated page_ids too. An empty table gives no rows.
    """
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.verdict, length(r.h || r.p) AS n
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC NULLS LAST) AS k FROM m)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM k WHERE k = 1
"""
