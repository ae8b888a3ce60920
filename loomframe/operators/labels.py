"""Label tables: last entry wins, lookups, resume, cleaned labels, disputes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import truth
from ..functions.text import is_filled, starts_yes, yes_no


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last in order. Combined before the shuffle, so a key with very many rows is no hot spot."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.`{c}`").alias(c) for c in df.columns])


def label_lookup(splits: DataFrame, enriched: DataFrame) -> DataFrame:
    """splits(id, classification, batch_name, split, ord), enriched(video_id, summary, layout_category, is_sludge, ord).

    A label row for each id of a split; enrichment of other ids is left out. An enriched row's missing texts are
    empty, texts of an id without enrichment are null.
    """
    s = last_wins(splits, ["id"], ["ord"]).select(F.col("id").alias("video_id"), "classification", "batch_name", "split")
    e = last_wins(enriched, ["video_id"], ["ord"]).select("video_id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("layout_category", F.lit("")).alias("layout_category"), "is_sludge")
    return s.join(e, "video_id", "left")


def with_labels(frames: DataFrame, labels: DataFrame, key: str = "video_id") -> DataFrame:
    """Every frame, with its label columns or nulls."""
    return frames.join(labels, key, "left")


def in_splits(files: DataFrame, labels: DataFrame, splits: list[str], key: str = "video_id") -> DataFrame:
    """Files whose id is labelled in one of the splits."""
    return files.join(labels.where(F.col("split").isin(*splits)).select(key), key, "left_semi")


def not_done(rows: DataFrame, done: DataFrame, key: str = "frame_path", retry_errors: bool = False, raw: str = "teacher_raw") -> DataFrame:
    """Rows whose key an earlier run did not write. Errors count as done unless they are to be retried."""
    done = done.where(F.col(key).isNotNull())
    if retry_errors:
        done = done.where(~F.coalesce(F.startswith(F.col(raw), F.lit("__ERROR__")), F.lit(False)))
    return rows.join(done.select(key), key, "left_anti")


def manifest_rows(frames: DataFrame) -> DataFrame:
    return frames.select("video_id", "batch", "frame_path", F.bround("time_s", 2).alias("time_s"), "classification", "is_sludge", "layout_category", "summary", "split")


def teacher_rows(frames: DataFrame) -> DataFrame:
    """Labelled frames with the replies teacher_raw and teacher: label columns get the prefix gt_."""
    return frames.select("frame_path", "video_id", "split", "time_s", F.col("classification").alias("gt_classification"), F.col("is_sludge").alias("gt_is_sludge"), F.col("layout_category").alias("gt_layout"), "teacher_raw", "teacher")


def judge_rows(rows: DataFrame) -> DataFrame:
    """Disputed rows with the structs teacher and judged, flat."""
    teacher = [F.col(f"teacher.{a}").alias(f"teacher_{b}") for a, b in (("sludge", "sludge"), ("layout", "layout"), ("description", "desc"))]
    return rows.select("frame_path", "video_id", "split_source", "gt_is_sludge", *teacher, F.col("judged.sludge").alias("judge_sludge"), F.col("judged.reason").alias("judge_reason"), "judge_raw")


def evaluation_rows(rows: DataFrame, prompts: dict[str, str]) -> DataFrame:
    """rows(video_id, batch, frame_path, gt, layout, summary, explain_prompt and the replies classify, layout_reply, describe, explain) to nested records.

    prompts: of classify, layout and describe. A hit is null where the label or a parsed answer is missing; a layout is a hit if one of the two
    lower-cased texts is within the other, and null if either is empty.
    """
    parsed = yes_no(F.col("classify"))
    both = is_filled(F.col("layout")) & is_filled(F.col("layout_reply"))
    a, b = F.lower("layout"), F.lower("layout_reply")
    reply = lambda prompt, name, *more: F.struct(prompt.alias("prompt"), F.col(name).alias("reply"), *more)
    truth_ = F.struct(F.col("gt").alias("classification"), F.col("layout").alias("layout_category"), F.col("summary").alias("enriched_summary"))
    outputs = F.struct(
        reply(F.lit(prompts["classify"]), "classify", parsed.alias("parsed_sludge"), (parsed == F.col("gt")).alias("hit")).alias("classify"),
        reply(F.lit(prompts["layout"]), "layout_reply", F.when(both, F.contains(a, b) | F.contains(b, a)).alias("hit")).alias("layout"),
        reply(F.lit(prompts["describe"]), "describe").alias("describe"),
        reply(F.col("explain_prompt"), "explain").alias("explain"),
    )
    return rows.select("video_id", "batch", "frame_path", truth_.alias("ground_truth"), outputs.alias("model_outputs"))


def judged_of(rows: DataFrame, split: str = "test") -> DataFrame:
    """Rows of one split that a judge has answered."""
    return rows.where((F.col("split_source") == split) & is_filled(F.col("judge_sludge")))


def is_dispute(teacher: Column, gt: Column, include_agreements: bool = False) -> Column:
    """The teacher answered, and (unless agreements count) otherwise than the label; a missing label is no."""
    return is_filled(teacher) & ((starts_yes(teacher) != truth(gt)) | F.lit(include_agreements))


def disputes(rows: DataFrame, teacher: str = "teacher_sludge", gt: str = "gt_is_sludge", include_agreements: bool = False) -> DataFrame:
    return rows.where(is_dispute(F.col(teacher), F.col(gt), include_agreements))


def count_by(rows: DataFrame, column: str, name: str = "n") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias(name))


def cleaned_labels(gt: DataFrame, verdicts: DataFrame) -> DataFrame:
    """gt(video_id, gt), verdicts(video_id, judge_sludge, ord): (video_id, gt, cleaned).

    The last filled verdict of a video replaces its label (leading white space makes a verdict no); videos that
    only verdicts know are inserted. A missing label is no.
    """
    v = last_wins(verdicts.where(is_filled(F.col("judge_sludge"))), ["video_id"], ["ord"]).select("video_id", starts_yes(F.col("judge_sludge"), stripped=False).alias("judged"))
    return gt.select("video_id", truth(F.col("gt")).alias("gt")).join(v, "video_id", "full_outer").select("video_id", "gt", F.coalesce("judged", "gt").alias("cleaned"))
