import json

import pytest
from pyspark.sql import functions as F

from loomframe.sources import config, files, schemas, sinks
from loomframe.streaming.incremental import run_incrementally, stream_lines


def write(path, text):
    path.write_text(text)
    return str(path)


def test_splits_and_lines(spark, tmp_path):
    a = write(tmp_path / "train.json", json.dumps([{"id": "a", "classification": True, "batch_name": "b"}]))
    b = write(tmp_path / "test.json", json.dumps([{"id": "a", "classification": False, "batch_name": "b"}]))
    assert sorted((r["split"], r["ord"]) for r in files.read_splits(spark, {"train": a, "test": b}).collect()) == [("test", 1), ("train", 0)]
    good = write(tmp_path / "x.jsonl", '{"frame_path": "p"}\n')
    assert files.read_lines(spark, good, schemas.TEACHER).count() == 1
    bad = write(tmp_path / "y.jsonl", '{"frame_path": "p", "video_id": "v"}\n{"frame_pa\n{"video_id": "q"}\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_lines(spark, bad, schemas.TEACHER).collect()
    assert [r["frame_path"] for r in files.read_done(spark, bad, "frame_path string, video_id string").collect()] == ["p"]
    tagged = files.read_tagged(spark, {"train": good, "test": good}, schemas.TEACHER)
    assert sorted(r["split_source"] for r in tagged.collect()) == ["test", "train"]


def test_videos(spark, tmp_path):
    for d, names in (("b1", ["z.mp4", "a.mp4", "n.txt"]), ("b2", ["c.mp4"])):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_bytes(b"x")
    got = files.list_videos(spark, [str(tmp_path / "b1"), str(tmp_path / "b2")], limit=1)
    assert sorted((r["batch"], r["video_id"]) for r in got.collect()) == [("b1", "a"), ("b2", "c")]
    assert files.probe_duration(str(tmp_path / "b1/a.mp4")) == 0.0
    plan = files.plan_frames(got.withColumn("duration", F.lit(2.2)))
    assert sorted(r["frame_name"] for r in plan.collect()) == ["a_f0.jpg", "a_f1.jpg", "c_f0.jpg", "c_f1.jpg"]
    made = files.extract_frames(plan, str(tmp_path / "out"))
    assert tuple(files.extraction_counts(got, made).first()) == (2, 0, 2)


def test_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    (tmp_path / "b.jpg").write_bytes(b"")
    assert files.read_images(spark, str(tmp_path)).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "frame_path string, n int")
    out = str(tmp_path / "out")
    sinks.append_new(df.limit(1), out, None)
    done = files.read_done(spark, out, "frame_path string")
    sinks.append_new(df, out, done)
    assert sorted(r["frame_path"] for r in spark.read.json(out).collect()) == ["a", "b"]
    sinks.write_by(df, str(tmp_path / "by"), "frame_path")
    assert (tmp_path / "by" / "frame_path=a").exists()
    assert json.loads(sinks.as_array(df, ["n"]).first()["value"]) == [{"frame_path": "a", "n": 1}, {"frame_path": "b", "n": 2}]
    assert json.loads(sinks.summary_text(df.limit(1))) == {"frame_path": "a", "n": 1}
    assert set(sinks.keyed_by_text(df, "n").first()["by_key"]) == {"1", "2"}


def test_features_table(spark, tmp_path):
    f = spark.createDataFrame([("a", 0, True, [[1.0]]), ("b", 1, False, None)], schemas.FEATURES)
    p = str(tmp_path / "f")
    sinks.write_features(f, p, "float32", 1, 1, "x")
    assert files.read_features(spark, p, "float32").count() == 2
    assert spark.read.parquet(f"{p}/meta").first()["failed"] == 1
    assert [r["idx"] for r in files.read_failed(spark, p).collect()] == [1]
    with pytest.raises(ValueError):
        files.read_features(spark, p, "float16")
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_features(f, p, "float32", 1, 1, "x")
    sinks.write_features(f, p, "float32", 1, 1, "x", force=True)


def test_settings(tmp_path, monkeypatch):
    p = write(tmp_path / "c.yaml", "json_path: a.json\nmax_length: 1024\nextra_key: 3\n")
    s = config.read_settings(p, {"output_dir": "o", "loss_log": None})
    assert (s.json_path, s.max_length, s.output_dir, s.extra) == ("a.json", 1024, "o", {"extra_key": 3})
    monkeypatch.setenv("X_PATH", "/y")
    assert config.env_path("X_PATH", "/z") == "/y" and config.env_path("X_NONE", "/z") == "/z"


def test_stream_writes_each_key_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    work = lambda df: df.withColumn("reply", F.lit("Yes."))
    for name, keys in (("1.json", ["a", "b", "a"]), ("2.json", ["b", "c"])):
        (src / name).write_text("".join(json.dumps({"frame_path": k}) + "\n" for k in keys))
        run_incrementally(stream_lines(spark, str(src), "frame_path string"), work, out, ck).awaitTermination()
    assert sorted(r["frame_path"] for r in spark.read.json(out).collect()) == ["a", "b", "c"]
