"""Reports: accuracy, judge tallies, agreement, batch-size sweeps, loss logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent, ratio, ratio_or_zero, truth
from ..functions.text import blank_to, is_filled, starts_yes


def classify_report(rows: DataFrame, pred: str, gt: str, error: str | None = None) -> DataFrame:
    """One row: totals, covered (answered and labelled), correct, unparseable, unlabelled, errors, accuracy on covered and on all."""
    p, g = F.col(pred), F.col(gt)
    covered, correct = p.isNotNull() & g.isNotNull(), F.coalesce(p == g, F.lit(False))
    x = rows.agg(
        F.count("*").alias("n_total"),
        F.count_if(covered).alias("n_covered"),
        F.count_if(correct).alias("n_correct"),
        F.count_if(p.isNull() & g.isNotNull()).alias("n_unparseable"),
        F.count_if(g.isNull()).alias("n_no_label"),
        (F.count_if(F.col(error).isNotNull()) if error else F.lit(0).cast("long")).alias("n_errors"),
    )
    return x.withColumn("accuracy", ratio(F.col("n_correct"), F.col("n_covered"))).withColumn("accuracy_all", ratio(F.col("n_correct"), F.col("n_total")))


def per_layout(rows: DataFrame, pred: str, gt: str, layout: str) -> DataFrame:
    """The same by layout (`unknown` where blank), over labelled rows: n counts covered rows, unparseable ones are beside it."""
    p, g = F.col(pred), F.col(gt)
    x = rows.where(g.isNotNull()).groupBy(blank_to(F.col(layout), "unknown").alias("layout"))
    x = x.agg(F.count_if(p.isNotNull()).alias("n"), F.count_if(F.coalesce(p == g, F.lit(False))).alias("correct"), F.count_if(p.isNull()).alias("unparseable"))
    return x.withColumn("acc", ratio(F.col("correct"), F.col("n")))


def judge_tally(rows: DataFrame, teacher: str = "teacher_sludge", judge: str = "judge_sludge", gt: str = "gt_is_sludge") -> DataFrame:
    """Whom the judge sides with. Rows without a teacher but with a verdict are in the total only."""
    t, j, g = F.col(teacher), F.col(judge), truth(F.col(gt))
    failed = ~is_filled(j)
    valid = ~failed & is_filled(t)
    with_t, with_g = starts_yes(j) == starts_yes(t), starts_yes(j) == g
    return rows.agg(
        F.count("*").alias("n_disputes_judged"),
        F.count_if(failed).alias("errors"),
        F.count_if(valid & with_t & ~with_g).alias("judge_sides_with_teacher"),
        F.count_if(valid & with_g & ~with_t).alias("judge_sides_with_gt"),
        F.count_if(valid & (with_t == with_g)).alias("judge_agrees_with_both_or_neither"),
    )


def dual_rows(rows: DataFrame, pred: str, gt: str, cleaned: str) -> DataFrame:
    """rows plus gt_hit and cleaned_hit, null where nothing was predicted."""
    g = truth(F.col(gt))
    return rows.withColumn("gt_hit", F.col(pred) == g).withColumn("cleaned_hit", F.col(pred) == F.coalesce(F.col(cleaned), g))


def dual_report(rows: DataFrame, pred: str, gt: str, cleaned: str) -> DataFrame:
    """One row: accuracy against labels and against cleaned labels, over all rows, and how many labels differ."""
    x = dual_rows(rows, pred, gt, cleaned).agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col(pred).isNull()).alias("n_unparseable"),
        F.count_if("gt_hit").alias("gt_correct"),
        F.count_if("cleaned_hit").alias("cleaned_correct"),
        F.count_if(F.coalesce(F.col(cleaned), truth(F.col(gt))) != truth(F.col(gt))).alias("overrides_applied"),
    )
    return x.withColumn("gt_acc", ratio_or_zero(F.col("gt_correct"), F.col("n_total"))).withColumn("cleaned_acc", ratio_or_zero(F.col("cleaned_correct"), F.col("n_total")))


def paired(replies: DataFrame, key: str, run: str, reply: str, a: str, b: str) -> DataFrame:
    """replies in long form (key, run, reply) to (key, a, b): the replies of two runs, joined by key, never by position. Keys of one run only are left out."""
    one = lambda name: replies.where(F.col(run) == name).select(key, F.col(reply).alias(name))
    return one(a).join(one(b), key)


def agreement(pairs: DataFrame, same_text: Column, same_object: Column, same_first: Column, same_second: Column) -> DataFrame:
    """One row: pairs, equal texts, objects and fields, and their per cent to one place."""
    names = ("byte_identical", "json_identical", "sludge_match", "layout_match")
    x = pairs.agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in zip(names, (same_text, same_object, same_first, same_second), strict=True)])
    return x.withColumns({f"{n}_pct": percent(F.col(n), F.col("n")) for n in names})


def first_diffs(pairs: DataFrame, a: str, b: str, order: str, n: int = 5) -> DataFrame:
    return pairs.where(~F.col(a).eqNullSafe(F.col(b))).orderBy(order).limit(n)


def sweep_report(runs: DataFrame, size: str = "batch_size", seconds: str = "time_s", frames: str = "n_frames", failed: str | None = None) -> DataFrame:
    """runs, one row a batch size: seconds a frame and the speed-up over size 1; sizes after the first failure are left out."""
    w = Window.orderBy(size)  # a row a batch size: a handful
    x = runs
    if failed:
        earlier = F.coalesce(F.max(F.col(failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        x = x.withColumn("_e", earlier).where("_e = 0").drop("_e")
    base = F.first(F.when(F.col(size) == 1, F.col(seconds)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return x.withColumn("s_per_frame", F.col(seconds) / F.col(frames)).withColumn("speedup_vs_serial", ratio(base, F.col(seconds)))


def running_accuracy(rows: DataFrame, hit: str, order: str, every: int, group: str | None = None, block: int = 10_000) -> DataFrame:
    """(place, hits, accuracy) at each `every`-th row; order is a dense place from 1.

    Hits are summed by blocks of places first; a window runs over blocks and, apart, within a block.
    """
    by = [group] if group else []
    x = rows.select(*by, F.col(order).alias("place"), truth(F.col(hit)).cast("long").alias("h")).withColumn("_b", F.floor((F.col("place") - 1) / block))
    sums = x.groupBy(*by, "_b").agg(F.sum("h").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", before).drop("_s")
    inside = F.sum("h").over(Window.partitionBy(*by, "_b").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_in", inside).where(F.col("place") % every == 0).join(sums, [*by, "_b"])
    return x.select(*by, "place", (F.col("_in") + F.col("_before")).alias("hits")).withColumn("accuracy", F.col("hits") / F.col("place"))


def best_checkpoint(log: DataFrame, step: str = "step", loss: str = "eval_loss", group: list[str] | None = None) -> DataFrame:
    """The step with the smallest evaluation loss, of equal ones the earliest."""
    best = F.min(F.when(F.col(loss).isNotNull(), F.struct(F.col(loss).alias("l"), F.col(step).alias("s"))))
    return log.groupBy(*(group or [])).agg(best.alias("m")).select(*(group or []), F.col("m.s").alias("best_step"), F.col("m.l").alias("best_loss"))


def early_stop(log: DataFrame, step: str, loss: str, patience: int = 2, group: str | None = None) -> DataFrame:
    """(group, stop_step): the first evaluation after which `patience` in a row did not improve; null if there is none."""
    w = Window.partitionBy(group) if group else Window.partitionBy()
    e = log.where(F.col(loss).isNotNull())
    best = F.min(loss).over(w.orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_n", F.row_number().over(w.orderBy(step))).withColumn("_better", best.isNull() | (F.col(loss) < best))
    last = F.max(F.when(F.col("_better"), F.col("_n"))).over(w.orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("_since", F.col("_n") - last)
    return e.groupBy(*([group] if group else [])).agg(F.min(F.when(F.col("_since") >= patience, F.col(step))).alias("stop_step"))


def first_last_mean(log: DataFrame, value: str, order: list[str], k: int = 3, group: str | None = None) -> DataFrame:
    """Means of the first and of the last k values, and the drop; ranks are cut before the shuffle."""
    by = [group] if group else []
    w = Window.partitionBy(*by)
    head = log.withColumn("_k", F.row_number().over(w.orderBy(*order))).where(F.col("_k") <= k).select(*by, F.col(value).alias("v"), F.lit(True).alias("_head"))
    tail = log.withColumn("_k", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).where(F.col("_k") <= k).select(*by, F.col(value).alias("v"), F.lit(False).alias("_head"))
    mean = lambda c: F.avg(F.when(c, F.col("v")))
    both = head.union(tail).groupBy(*by).agg(mean(F.col("_head")).alias("first_mean"), mean(~F.col("_head")).alias("last_mean"))
    return both.withColumn("drop", F.col("first_mean") - F.col("last_mean"))


def containment_report(rows: DataFrame, hit: str, gt: str) -> DataFrame:
    """Layout accuracy over rows with a label."""
    x = rows.where(is_filled(F.col(gt))).agg(F.count("*").alias("n"), F.count_if(F.col(hit)).alias("correct"))
    return x.withColumn("accuracy", ratio(F.col("correct"), F.col("n")))
