"""Fill-in-the-middle: texts cut in three at two ranks of their units, moved so that the middle comes last.

Matching is streaming and takes two passes of constant memory: the first counts the units, the second advances a lazy
iterator of matches to the two ranks and reads where it stands. No list of units exists at any time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, slices, small_batches, table

#: A run of ASCII letters, or any other code point.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def count_units(unit: re.Pattern, text: str) -> int:
    return sum(1 for _ in unit.finditer(text))


def places(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """The ends of the low-th and of the high-th unit (low <= high): code points before the middle and before the suffix."""
    at, found = [], unit.finditer(text)
    for step in (low, high - low):
        m = next(islice(found, step - 1, None)) if step else None
        at.append(m.end() if m else at[-1] if at else 0)
    return at[0], at[1]


def moved(unit: re.Pattern, text: str, seed: str, plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix's length, middle's length, output) of a text; the seed's hash makes all choices."""
    n = count_units(unit, text)
    h = hashlib.sha256(seed.encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= 100 - plain or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    a, b = h1 % (n + 1), h2 % (n + 1)
    a, b = places(unit, text, min(a, b), max(a, b))
    first, middle, last = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{last}{PREFIX}{first}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{first}{SUFFIX}{last}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = UNIT, seed: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """docs(doc_id, text) to doc_id, n, form, prefix_chars, middle_chars, output; `plain` and `spm` are percentages.

    The choices of a row are the sha256 of `seed:doc_id` (nothing after the colon where doc_id is null). Rows stay where they are: no shuffle.
    A null text is empty; empty texts and texts that hold a marker are plain. Repeated rows come out as often as they are given.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0).to_pylist()
                rows = [moved(pattern, t.as_py() or "", f"{seed}:{'' if i is None else i}", plain, spm) for i, t in zip(ids, part.column(1), strict=True)]
                n, form, first, middle, out = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(frugal(run), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: the parts between the markers, which no part contains."""
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    middle = F.substring(output, m + 3, F.length(output))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents in its form, with the digests of the output and of the text rebuilt from output and form.

    Null and empty texts: n 0, plain, the digests of no bytes. Very long texts take time by their length and no list of their units.
    Repeated ids make equal choices. An empty table gives no rows. Only doc_id and text are read.
    """
    x = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, [('0x' || substr(x, 8 * i + 1, 8))::BIGINT for i in range(4)] AS h FROM d),
c AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a+1:b], '') AS m, array_to_string(u[b+1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) WHEN 'spm' THEN concat('<S>', s, '<P>', p, '<M>', m) ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
