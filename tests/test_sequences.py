import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import sequences as Q
from loomframe.operators import batches

TURNS = "array<struct<from:string,value:string>>"


def one(spark, kind, value, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_sentinels(spark):
    got = one(spark, "array<string>", ["a bb", "ccc", ""], lambda c: Q.with_sentinels(c, Q.split_tokens))
    assert got == [1, 2, -200, 3, -200]


def test_image_is_text_without_an_image(spark):
    df = spark.createDataFrame([("<image> b", True), ("<image> b", False)], "v string, i boolean")
    got = [r[0] for r in df.select(Q.tokens_with_image(F.col("v"), F.col("i"), Q.split_tokens)).collect()]
    assert got == [[-200, 1], [7, 1]]


def test_chat_turns_drop_one_leading_turn(spark):
    got = one(spark, TURNS, [("system", "s"), ("system", "t"), ("human", "q"), ("gpt", "a"), ("system", "u")], Q.chat_turns)
    assert [(t["role"], t["value"]) for t in got] == [("assistant", "t"), ("user", "q"), ("assistant", "a"), ("assistant", "u")]
    assert one(spark, TURNS, [("gpt", "a")], Q.chat_turns) == []
    assert one(spark, TURNS, [], Q.chat_turns) == []


def test_labels_cover_the_assistant_only(spark):
    def f(c):
        ids, labels = Q.joined(Q.chat_segments(Q.chat_turns(c), F.lit(True), Q.split_tokens))
        return F.struct(ids.alias("ids"), labels.alias("labels"))

    got = one(spark, TURNS, [("human", "<image> q"), ("gpt", "an swer")], f)
    assert len(got["ids"]) == len(got["labels"])
    supervised = [i for i, y in zip(got["ids"], got["labels"]) if y != -100]
    assert supervised == [2, 4, 11] and -200 in got["ids"]


def test_render(spark):
    assert one(spark, "string", "hi", Q.render_prompt) == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    got = one(spark, "array<struct<role:string,content:array<struct<type:string,text:string>>>>", [("user", [("image", None), ("text", "q")])], lambda c: Q.render_template(c, 2, True))
    assert got == "<|im_start|>user\n<image><image>\nq<|im_end|>\n<|im_start|>assistant\n"


def test_caption_ignores_the_first_turn(spark):
    got = one(spark, TURNS, [("human", "anything"), ("gpt", "a b")], lambda c: F.struct(*[x.alias(n) for x, n in zip(Q.caption_sample(c, Q.split_tokens), "il")]))
    assert got["i"] == [-200, 1, 11] and got["l"] == [-100, 1, 11]


def test_splice(spark):
    df = spark.createDataFrame([([1, -200, 3], [9, 9, 8]), ([1, 2], [9, 9])], "ids array<long>, labels array<long>")
    got = [r[0] for r in df.select(Q.splice_labels(F.col("labels"), F.col("ids"), 2)).collect()]
    assert got == [[9, -100, -100, 8], [9, 9]]
    two = spark.createDataFrame([([-200, -200], [1, 1])], "ids array<long>, labels array<long>")
    with pytest.raises(Exception, match="more than one image"):
        two.select(Q.splice_labels(F.col("labels"), F.col("ids"))).collect()


def test_truncate_may_cut_the_sentinel(spark):
    assert one(spark, "array<long>", [1, 2, -200], lambda c: Q.truncate(c, 2)) == [1, 2]
    assert one(spark, "array<long>", [1, 2], lambda c: Q.truncate(c, None)) == [1, 2]


def test_padding_and_collation(spark):
    df = spark.createDataFrame([(0, 0, [1, 2], [1, -100]), (1, 0, [3], [3]), (2, 1, [4], [4])], "ord int, batch_id int, input_ids array<long>, labels array<long>")
    got = {r["batch_id"]: r for r in batches.collated(batches.padded(df, "batch_id", 0), "batch_id", "ord").collect()}
    assert got[0]["input_ids"] == [[1, 2], [3, 0]] and got[0]["labels"] == [[1, -100], [3, -100]] and got[0]["attention_mask"] == [[1, 1], [1, 0]]
    assert got[1]["input_ids"] == [[4]]


def test_numbered_in_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = batches.numbered(df, ["x"], rows_per_part=90).collect()
    assert all(r["x"] == r["ord"] for r in got) and len(got) == 1000


def test_length_groups(spark):
    df = spark.range(100).select("id", (F.col("id") % 13).alias("n"))
    rows = batches.length_groups(df, "id", "n", 10).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["mega_id"], r["place"])):
        by.setdefault(r["mega_id"], []).append(r["n"])
    assert all(v == sorted(v, reverse=True) for v in by.values()) and len(rows) == 100


def test_projection(spark):
    rng = np.random.default_rng(0)
    w, b, v = rng.normal(size=(3, 4)), rng.normal(size=3), [1.0, -2.0, 0.5, 3.0]
    df = spark.createDataFrame([(v,)], "v array<float>")
    assert np.allclose(Q.project(df, "v", w, b).first()["projected"], w @ v + b)
    assert np.allclose(df.select(Q.project_small(F.col("v"), w.tolist(), b.tolist()).alias("y")).first()["y"], w @ v + b)


def test_features_of_text_rows(spark):
    assert spark.range(1).select(Q.zero_features(2, 3).alias("z")).first()["z"] == [[0.0] * 3] * 2
    assert one(spark, "array<array<float>>", [[1.0], [2.0]], lambda c: Q.first_rows(c, 1)) == [[1.0]]
    assert one(spark, "array<long>", [-200, 5], Q.embeddable) == [0, 5]


def test_places_within_groups(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("o"))
    got = batches.numbered_within(df, "g", ["o"]).collect()
    for g in range(3):
        rows = sorted((r for r in got if r["g"] == g), key=lambda r: r["o"])
        assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
