"""Pixels, durations, harness, arrays in parts, buckets, nested records."""

import json
import math
import re
import struct
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import batches, features, harness, labels
from loomframe.operators.inference import encode_images
from loomframe.sources import arrays, media, sinks
from loomframe.sources.shared import fresh_path

# --- pixels ---


def test_decode_formats():
    colour = bytes(range(12))
    assert media.decode(b"P6 2 2 255\n" + colour).tolist() == np.arange(12).reshape(2, 2, 3).tolist()
    assert media.decode(b"P5\n# a comment\n2 # another\n1\n255\n\x05\x07").tolist() == [[[5] * 3, [7] * 3]]
    assert media.decode(b"P5 2 1 15 \x0f\x05").tolist() == [[[255] * 3, [85] * 3]]
    assert media.decode(b"P5 1 1 255 \n").tolist() == [[[10] * 3]]  # one white space ends the header, the next byte is a pixel
    for bad in (None, b"", b"P6 2 2 255\n" + colour[:-1], b"P6 0 2 255\n", b"P6 2 2 65535\n" + colour * 2, b"P3 1 1 255 1 2 3", b"\xff\xd8\xff", b"P5 2 1"):
        with pytest.raises(ValueError):
            media.decode(bad)


@pytest.mark.parametrize(("h", "w", "side"), [(1, 1, 4), (3, 5, 8), (9, 7, 4), (8, 8, 8)])
def test_resize_against_loops(h, w, side):
    rng = np.random.default_rng(h * w)
    x = rng.integers(0, 256, (h, w, 3))

    def place(i, n):
        s = min(max((i + 0.5) * n / side - 0.5, 0), n - 1)
        low = math.floor(s)
        return [(low, 1 - (s - low)), (min(low + 1, n - 1), s - low)]

    want = [[sum(f * g * x[a, b] for a, f in place(i, h) for b, g in place(j, w)) for j in range(side)] for i in range(side)]
    assert np.allclose(media.resize(x, side), want)


def test_encoder_marks_unreadable_images(spark):
    good = b"P5 1 1 255 \x14"
    images = spark.createDataFrame([("a", 0, good), ("b", 1, b"no"), ("c", 2, None), (None, 3, good)], "image string, idx long, content binary")
    got = {r["image"]: r for r in encode_images(images, media.patch_encoder(np.array([[1.0, 0, 0], [1, 1, 1]]))).collect()}
    assert set(got) == {"a", "b", "c"} and not got["b"]["ok"] and got["c"]["features"] is None
    assert len(got["a"]["features"]) == 32 and np.allclose(got["a"]["features"], [[20, 60]] * 32)


def test_replies_to_images(spark):
    rows = [(k, b"P5 1 1 255 " + bytes([k]) if k % 4 else b"cut") for k in range(20)] + [(99, None)]
    images = spark.createDataFrame(rows, "k long, content binary").coalesce(1)
    sizes = lambda: lambda batch: [f"{x.shape[0]}:{int(x.max())}" for x in batch]
    got = {r["k"]: r["reply"] for r in media.reply_to_images(images, sizes, 3).collect()}
    assert got == {k: f"1:{k}" if k % 4 and k != 99 else "__ERROR__: image_open_failed" for k, _ in rows}

    def fails(batch):
        if any(x.max() == 5 for x in batch):
            raise RuntimeError("five")
        return ["ok"] * len(batch)

    got = {r["k"]: r["reply"] for r in media.reply_to_images(images, lambda: fails, 3).collect()}
    assert got[5] == got[3] == "__ERROR__: RuntimeError: five" and got[4] == "__ERROR__: image_open_failed" and got[6] == "ok"


# --- durations ---


def box(kind, body, wide=False):
    return (struct.pack(">I4sQ", 1, kind, len(body) + 16) if wide else struct.pack(">I4s", len(body) + 8, kind)) + body


def movie(version, scale, duration):
    return bytes([version, 0, 0, 0]) + (struct.pack(">QQIQ", 0, 0, scale, duration) if version else struct.pack(">IIII", 0, 0, scale, duration)) + bytes(80)


def test_durations_of_heads():
    head = box(b"ftyp", b"isom0000")
    for version, wide in ((0, False), (1, False), (0, True), (1, True)):
        inner = box(b"udta", b"x") + box(b"mvhd", movie(version, 600, 1500), wide)
        assert media.movie_seconds(head + box(b"free", bytes(5), wide) + box(b"moov", inner, wide) + box(b"mdat", bytes(9))) == 2.5
    open_end = struct.pack(">I4s", 0, b"moov") + box(b"mvhd", movie(0, 10, 25))
    assert media.movie_seconds(open_end) == 2.5
    long = box(b"moov", box(b"mvhd", movie(0, 10, 25)) + bytes(100))
    assert media.movie_seconds(head + long[:60]) == 2.5  # the first bytes are enough
    for bad in (None, b"", b"\0" * 7, head, head + long[:24], box(b"moov", box(b"mvhd", movie(0, 0, 25))), box(b"moov", box(b"mvhd", movie(0, 10, 2**32 - 1))), box(b"moov", box(b"mvhd", movie(2, 10, 25))), struct.pack(">I4s", 4, b"moov") + bytes(40), box(b"moov", b"")):
        assert media.movie_seconds(bad) == 0.0


# --- harness ---


def test_sweep_measures_and_stops(spark):
    class Slow:
        def reply(self, batch):
            if len(batch) > 4:
                raise MemoryError("no room")
            sum(range(20_000))
            return ["Yes."] * len(batch)

    rows = spark.range(40).withColumnRenamed("id", "k").coalesce(2)
    report, replies = harness.sweep(rows, Slow, [1, 2, 8, 16])
    got = {r["batch_size"]: r for r in report.collect()}
    assert sorted(got) == [1, 2, 8] and [got[s]["n_frames"] for s in (1, 2, 8)] == [40] * 3
    assert got[1]["n_errors"] == got[2]["n_errors"] == 0 and got[8]["n_errors"] > 0 and got[8]["error"] == "__ERROR__: MemoryError: no room"
    assert all(got[s]["time_s"] > 0 and got[s]["wall_s"] > 0 and math.isclose(got[s]["frames_per_s"], 40 / got[s]["time_s"]) for s in (1, 2))
    assert replies.groupBy("run").count().collect().__len__() == 2 and replies.where("reply = 'Yes.'").count() == 80
    none, no_replies = harness.sweep(rows.where("k < 0"), Slow, [8])
    assert none.first()["n_frames"] == 0 and none.first()["time_s"] == 0 and no_replies.count() == 0


# --- arrays and buckets ---


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_parts_are_one_array(spark, n):
    rows = [(k % 30, None if k % 5 == 0 else f'"{k}]\n[,é') for k in range(n)]
    path = fresh_path(spark, "array")
    arrays.write_array(spark.createDataFrame(rows, "k long, v string"), path, ["k", "v"], rows_per_part=9)
    parts = sorted(Path(urlparse(path).path).glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert whole == [{"k": k, "v": v} for k, v in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))]
    assert len(parts) >= max(1, n // 9)
    back = arrays.read_array_parts(spark, path, "k long, v string")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)


def test_buckets_spare_the_features_a_shuffle(spark):
    cache = spark.range(200).selectExpr("concat('v', id) AS image", "true AS ok", "array(array(float(id))) AS features")
    name = "bucketed_features_of_a_test"
    sinks.write_buckets(cache, fresh_path(spark, "buckets"), name, 5)
    records = spark.range(300).selectExpr("concat('v', id) AS image")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        x = features.with_features(records, spark.table(name), rows=1, width=1)
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Bucketed: true" in plan
        assert x.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql(f"DROP TABLE {name}")


# --- records and prompts ---


def test_hits_of_nested_records(spark):
    names = "video_id string, batch string, frame_path string, gt boolean, layout string, summary string, classify string, layout_reply string, describe string, explain string, explain_prompt string"
    rows = [("a", "b", "f", True, "Grid", "s", "Yes.", "a grid view", "d", "e", "Why?"), ("b", "b", "f", None, "", None, "no", "x", None, None, None), ("c", "b", "f", False, "grid", "s", "hm", None, "d", None, None), ("d", "b", "f", False, "grid", "s", None, "", "d", None, None)]
    x = labels.evaluation_rows(spark.createDataFrame(rows, names), {"classify": "C", "layout": "L", "describe": "D"})
    got = {r["video_id"]: r["model_outputs"] for r in x.collect()}
    assert [got[k]["classify"]["hit"] for k in "abcd"] == [True, None, None, None] and [got[k]["classify"]["parsed_sludge"] for k in "abcd"] == [True, False, None, None]
    assert [got[k]["layout"]["hit"] for k in "abcd"] == [True, None, None, None] and got["a"]["explain"]["prompt"] == "Why?"


def test_left_padding(spark):
    x = spark.createDataFrame([(0, [5, 6], [1, 1], [-100] * 2), (0, [7], [1], [-100]), (0, None, None, None), (1, [8], [1], [-100])], "b long, input_ids array<long>, attention_mask array<long>, labels array<long>")
    got = sorted((r["b"], r["input_ids"], r["attention_mask"], r["labels"]) for r in batches.left_padded(x, "b", 0).collect())
    assert got == [(0, [0, 0], [0, 0], [-100] * 2), (0, [0, 7], [0, 1], [-100] * 2), (0, [5, 6], [1, 1], [-100] * 2), (1, [8], [1], [-100])]


def test_judged_rows_of_a_split(spark):
    x = spark.createDataFrame([("test", "yes"), ("test", ""), ("test", None), ("train", "no"), (None, "no"), ("test", " ")], "split_source string, judge_sludge string")
    assert sorted(r["judge_sludge"] for r in labels.judged_of(x).select("judge_sludge").where(F.lit(True)).collect()) == [" ", "yes"]
