import pytest
from pyspark.sql import functions as F

from loomframe.operators import batches, conversations, features, labels, metrics, sampling
from loomframe.operators.inference import Stub, encode_images, infer, infer_once


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_label_lookup_last_entry_wins(spark):
    s = spark.createDataFrame([("a", True, "b1", "train", 0), ("a", False, "b2", "test", 1), ("c", True, "b1", "train", 0)], "id string, classification boolean, batch_name string, split string, ord int")
    e = spark.createDataFrame([("a", "old", "x", True, 0), ("a", None, "grid", None, 1), ("z", "s", "l", True, 0)], "video_id string, summary string, layout_category string, is_sludge boolean, ord int")
    assert rows(labels.label_lookup(s, e), "video_id") == [("a", False, "b2", "test", "", "grid", None), ("c", True, "b1", "train", None, None, None)]


def test_disputes_and_tally(spark):
    df = spark.createDataFrame([("yes", False, "yes"), ("yes", True, "no"), ("", True, "yes"), (None, None, "yes"), ("no", None, ""), ("no", True, "yes"), (" Yes", None, "no")], "teacher_sludge string, gt_is_sludge boolean, judge_sludge string")
    assert labels.disputes(df).count() == 3
    assert labels.disputes(df, include_agreements=True).count() == 5
    t = metrics.judge_tally(df).first().asDict()
    assert t == {"n_disputes_judged": 7, "errors": 1, "judge_sides_with_teacher": 1, "judge_sides_with_gt": 2, "judge_agrees_with_both_or_neither": 1}


def test_cleaned_labels(spark):
    gt = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "video_id string, gt boolean")
    v = spark.createDataFrame([("a", "yes", 0), ("a", "no", 1), ("c", " yes", 0), ("z", "Yes", 0), ("b", "", 0)], "video_id string, judge_sludge string, ord int")
    assert rows(labels.cleaned_labels(gt, v), "video_id") == [("a", True, False), ("b", False, False), ("c", False, False), ("z", None, True)]


def test_resume(spark):
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "frame_path string")
    done = spark.createDataFrame([("a", "ok"), ("b", "__ERROR__: X: y"), (None, "ok")], "frame_path string, teacher_raw string")
    assert rows(labels.not_done(new, done), "frame_path") == [("c",)]
    assert rows(labels.not_done(new, done, retry_errors=True), "frame_path") == [("b",), ("c",)]


def test_rows_for_writing(spark):
    f = spark.createDataFrame([("v", "b", "p", 1.005, True, False, "grid", "s", "train", "raw", ("yes", "grid", "d", None))], "video_id string, batch string, frame_path string, time_s double, classification boolean, is_sludge boolean, layout_category string, summary string, split string, teacher_raw string, teacher struct<sludge:string,layout:string,description:string,explanation:string>")
    assert labels.manifest_rows(f).columns[0] == "video_id"
    assert labels.teacher_rows(f).first()["gt_layout"] == "grid"
    j = f.select("frame_path", "video_id", F.lit("test").alias("split_source"), F.col("is_sludge").alias("gt_is_sludge"), "teacher", F.struct(F.lit("no").alias("sludge"), F.lit("r").alias("reason")).alias("judged"), F.lit("x").alias("judge_raw"))
    assert labels.judge_rows(j).first()["judge_reason"] == "r"


@pytest.mark.parametrize("parts", [1, 8])
def test_sampling_ignores_layout(spark, parts):
    df = spark.range(500).select((F.col("id") % 7).alias("g"), "id")
    want = rows(sampling.sample_by_group(df.coalesce(1), "g", "id", 5), "g", "id")
    assert rows(sampling.sample_by_group(df.orderBy(F.desc("id")).repartition(parts), "g", "id", 5), "g", "id") == want and len(want) == 35
    done = spark.createDataFrame([(want[0][1],)], "id long")
    got = sampling.sample_excluding(df, done, "g", "id", 5, 12)
    assert got.count() == 12 and want[0][1] not in [r["id"] for r in got.collect()]


def test_limit_and_split(spark):
    df = spark.range(5)
    assert sampling.limit_rows(df, ["id"], 0).count() == 5 and sampling.limit_rows(df, ["id"], 2).count() == 2
    r = spark.createDataFrame([("a", "x"), ("b", "x")], "video_id string, split string")
    assert rows(sampling.with_split(r, spark.createDataFrame([("a", "train")], "video_id string, split string")), "video_id") == [("a", "train")]


def teacher(spark, sludge, layout, text, why, task, split="train", time=2.7):
    return spark.createDataFrame([("frames/v/f.jpg", "v", time, split, (sludge, layout, text, why), task)], "frame_path string, video_id string, time_s double, split string, teacher struct<sludge:string,layout:string,description:string,explanation:string>, task string")


def test_conversations(spark):
    c = conversations.build_conversations(teacher(spark, " Yes", "  ", " text ", "", "coupled")).first()
    assert c["id"] == "tiktok_v_f2_coupled" and c["image"] == "v/f.jpg" and c["_meta"].asDict() == {"split": "train", "task": "coupled", "layout": "other", "is_sludge": True}
    turns = c["conversations"]
    assert [t["from"] for t in turns] == ["human", "gpt", "human", "gpt"] and turns[1]["value"] == "Yes." and turns[3]["value"] == "Yes, this is sludge. text"
    c = conversations.build_conversations(teacher(spark, None, "grid", "  ", None, "refuse", time=None)).first()
    assert c["id"] == "tiktok_v_f0_refuse" and c["conversations"][1]["value"].endswith("The frame shows a single continuous scene.")
    with pytest.raises(Exception, match="unknown task"):
        conversations.build_conversations(teacher(spark, None, None, "x", None, "other")).collect()


def test_eligible_takes_white_space(spark):
    df = teacher(spark, "no", "x", "  ", None, "layout").union(teacher(spark, "no", "x", "", None, "layout")).union(teacher(spark, "no", "x", "d", None, "layout", "test"))
    assert conversations.eligible(df).count() == 1


def test_reports(spark):
    df = spark.createDataFrame([(True, True, "grid"), (None, True, "grid"), (False, True, ""), (True, None, "x"), (None, False, "solo")], "pred boolean, gt boolean, layout string")
    assert metrics.classify_report(df, "pred", "gt").first().asDict() == {"n_total": 5, "n_covered": 2, "n_correct": 1, "n_unparseable": 2, "n_no_label": 1, "n_errors": 0, "accuracy": 0.5, "accuracy_all": 0.2}
    assert rows(metrics.per_layout(df, "pred", "gt", "layout"), "layout") == [("grid", 1, 1, 1, 1.0), ("solo", 0, 0, 1, None), ("unknown", 1, 0, 0, 0.0)]
    d = spark.createDataFrame([(True, None, True), (None, True, None), (False, True, False)], "pred boolean, gt boolean, cleaned boolean")
    r = metrics.dual_report(d, "pred", "gt", "cleaned").first()
    assert (r["gt_correct"], r["cleaned_correct"], r["n_unparseable"], r["overrides_applied"]) == (0, 2, 1, 2)
    assert metrics.dual_report(d.limit(0), "pred", "gt", "cleaned").first()["gt_acc"] == 0.0


def test_sweep_stops_at_the_first_failure(spark):
    df = spark.createDataFrame([(1, 40, 200.0, False), (4, 40, 100.0, False), (8, 40, 50.0, True), (16, 40, 20.0, False)], "batch_size int, n_frames int, time_s double, failed boolean")
    got = metrics.sweep_report(df, failed="failed")
    assert [(r["batch_size"], r["speedup_vs_serial"]) for r in got.orderBy("batch_size").collect()] == [(1, 1.0), (4, 2.0), (8, 4.0)]


def test_checkpoints(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, 4.0), (4, 4.5), (5, 1.0), (6, None)], "step long, eval_loss double")
    assert tuple(metrics.best_checkpoint(df).first()) == (5, 1.0)
    assert metrics.early_stop(df, "step", "eval_loss", 2).first()["stop_step"] == 4
    assert metrics.early_stop(df.where("step < 3"), "step", "eval_loss", 2).first()["stop_step"] is None


def test_running_accuracy_over_blocks(spark):
    df = spark.range(1, 101).select(F.col("id").alias("o"), (F.col("id") % 3 == 0).alias("hit"))
    got = rows(metrics.running_accuracy(df, "hit", "o", 25, block=10), "place")
    assert got == [(k, k // 3, k // 3 / k) for k in (25, 50, 75, 100)]


def test_features(spark):
    rec = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "")], "id int, image string")
    cache = spark.createDataFrame([("a", 0, True, [[1.0]]), ("b", 1, False, None)], "image string, idx long, ok boolean, features array<array<float>>")
    got = features.with_reason(rec, cache)
    assert [r["status"] for r in got.orderBy("id").collect()] == ["kept", "failed", "uncached", "kept", "kept"]
    assert tuple(features.reasons(got).first()) == (3, 1, 1)
    joined = {r["id"]: r["features"] for r in features.with_features(rec, cache, rows=1, width=1).collect()}
    assert joined == {1: [[1.0]], 4: [[0.0]], 5: [[0.0]]}
    assert rows(features.failed_images(cache), "idx") == [(1, "b")]
    assert {r["id"] for r in features.existing_only(rec, spark.createDataFrame([("a",), ("a",)], "path string")).collect()} == {1, 4, 5}
    ids = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), (None, 3), ("", 4)], "image string, pos long")
    assert rows(features.dense_ids(ids, "image", "pos"), "idx") == [("b", 0), ("a", 1)]


def test_fallback_wraps_around(spark):
    df = spark.createDataFrame([(0, True), (1, False), (2, False), (3, False)], "ord long, ok boolean")
    assert [r["used"] for r in features.with_fallback(df, tries=3).orderBy("ord").collect()] == [0, None, 0, 0]


def test_inference(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("bad", 3)], "frame_path string, reply_no int")
    got = {r["frame_path"]: r["reply"] for r in infer(df, Stub, batch_size=1).collect()}
    assert got["bad"] == "__ERROR__: FileNotFoundError: bad" and got["a"] in ("Yes.", "No.")
    twice = df.where("frame_path <> 'bad'").union(df.where("frame_path <> 'bad'"))
    assert infer_once(twice, Stub, "frame_path").count() == 4


def test_encode_images(spark):
    df = spark.createDataFrame([("a", 0, b"12"), ("b", 1, b"")], "image string, idx long, content binary")

    def make():
        return lambda content: [[float(content[0])], [2.0], [3.0]]

    got = rows(encode_images(df, make, queries=2), "idx")
    assert got == [("a", 0, True, [[49.0], [2.0]]), ("b", 1, False, None)]


def test_places_over_many_ranges(spark, tmp_path):
    """Several ranges, further columns, repeated keys; written out, so that every column takes part."""
    rows = spark.range(20_000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 3).alias("g"), F.col("id").alias("id"), F.concat(F.lit("t"), "id").alias("row"), F.col("id").alias("part"))
    path = str(tmp_path / "n")
    batches.numbered(rows, ["k"], rows_per_part=1000).write.parquet(path)
    got = spark.read.parquet(path).toPandas()
    assert sorted(got["ord"]) == list(range(20_000)) and got.sort_values("ord")["k"].is_monotonic_increasing and (got["row"] == "t" + got["id"].astype(str)).all() and (got["part"] == got["id"]).all()
    path = str(tmp_path / "w")
    batches.numbered_within(rows, "g", ["k", "id"], rows_per_part=1000).write.parquet(path)
    got = spark.read.parquet(path).toPandas().sort_values(["g", "place"])
    for _, x in got.groupby("g"):
        assert list(x["place"]) == list(range(1, len(x) + 1)) and list(zip(x["k"], x["id"])) == sorted(zip(x["k"], x["id"]))


def test_pairs_are_joined_by_key(spark):
    runs = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2"), ("b", "y", "3"), ("a", "y", "4"), ("c", "y", "5")], "key string, run string, reply string")
    assert {tuple(r) for r in metrics.paired(runs, "key", "run", "reply", "x", "y").collect()} == {("a", "1", "4"), ("b", "2", "3")}


def test_places_are_turned_back_into_images(spark):
    ids = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 2)], "image string, idx long")
    asked = spark.createDataFrame([(1,), (1,), (7,)], "idx long")
    assert {tuple(r) for r in features.images_of(ids, asked).collect()} == {(1, "c"), (7, None)}
    assert features.images_of(ids, asked.limit(0)).count() == 0
