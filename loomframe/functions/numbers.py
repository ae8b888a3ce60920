"""Ratios, rounding and stable randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b with b taken as 1 where it is 0."""
    return a.cast("double") / F.greatest(b, F.lit(1)).cast("double")


def percent(a: Column, b: Column, places: int = 1) -> Column:
    """Per cent, rounded half to even."""
    return F.bround(a.cast("double") * 100 / b.cast("double"), places)


def truth(c: Column) -> Column:
    """Null as false."""
    return F.coalesce(c, F.lit(False))


def bucket(key: Column, seed: str = "") -> Column:
    """A number below 2 ** 32 from the key's md5: the same on every engine, whatever the order of rows."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long")


def choose(items: list[str], key: Column, seed: str = "") -> Column:
    """One of the items, by the key's bucket."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(bucket(key, seed), F.lit(len(items))) + 1).cast("int"))


def choose_weighted(weights: dict[str, int], key: Column, seed: str = "") -> Column:
    """One of the names, in proportion to their weights."""
    at = F.pmod(bucket(key, seed), F.lit(sum(weights.values())))
    out, below = None, 0
    for name, w in weights.items():
        below += w
        out = F.when(at < below, name) if out is None else out.when(at < below, name)
    return out


def frame_times(duration: Column, most: int = 30) -> Column:
    """Mid-second times of a video, thinned evenly to `most`; none for durations under a second."""
    n = duration.cast("int")
    second = lambda i: F.when(n > most, F.floor(i * (n / F.lit(float(most))))).otherwise(i)
    times = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1), lambda i: second(i) + F.lit(0.5))
    return F.when(n >= 1, times).otherwise(F.expr("cast(array() as array<double>)"))
