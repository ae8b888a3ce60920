"""Byte-pair ids, spliced feature rows, loss logs as streams, appends that count once."""

import datetime as dt
import json
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomframe.functions import bpe
from loomframe.functions import sequences as Q
from loomframe.operators import splice
from loomframe.sources.shared import fresh_path
from loomframe.streaming import committed, losses

FILE = Path("/opt/tokenizers/byte_bpe_50k.json")
needs_file = pytest.mark.skipif(not FILE.exists(), reason="needs the vocabulary file")
TEXTS = ["", " ", "Hello  world", "a\n\n b\t\tc  ", "don't 'SHE'LL we've", "x" * 3000, "漢字 かな \U0001f600 é", "  two", "12 345", "...!?  ", " nbsp　wide", "<|endoftext|> <image>", "a b", "tail   "]


# --- byte pairs ---


@pytest.fixture(scope="module")
def vocabulary():
    model = json.loads(FILE.read_text())["model"]
    return model["vocab"], {tuple(m): k for k, m in enumerate(model["merges"])}


def plain_merge(word, vocab, ranks):
    """All pairs looked at again after each merge."""
    names = bpe.byte_names()
    s = [names[b] for b in word.encode()]
    while len(s) > 1:
        best = min(range(len(s) - 1), key=lambda i: (ranks.get((s[i], s[i + 1]), 1 << 30), i))
        if (s[best], s[best + 1]) not in ranks:
            break
        s[best : best + 2] = [s[best] + s[best + 1]]
    return [vocab[x] for x in s]


@pytest.fixture(scope="module")
def pairs(spark):
    return bpe.BytePairs.of(*bpe.read_vocabulary(spark, f"file://{FILE}"))


@needs_file
def test_merges_of_words(pairs, vocabulary):
    rng = random.Random(1)
    words = ["", "a", " the", "lower", "aaaaaaaa", "\n\n\n", " 漢字"] + ["".join(rng.choice("abcdethinrs é") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    assert [pairs.merge(w) for w in words] == [plain_merge(w, *vocabulary) for w in words]


@needs_file
def test_ids_are_those_of_a_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(FILE))
    t.encode_special_tokens = True
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab 'sA.1\n\té漢") for _ in range(60)) for _ in range(100)]
    rows = spark.createDataFrame([(k, texts[k : k + 7] if k else None) for k in range(0, len(texts), 7)], "k long, texts array<string>")
    got = {r["k"]: r["ids"] for r in rows.select("k", bpe.tokenizer(spark, f"file://{FILE}")(F.col("texts")).alias("ids")).collect()}
    want = {k: [t.encode(x, add_special_tokens=False).ids for x in texts[k : k + 7]] for k in range(7, len(texts), 7)}
    assert got.pop(0) in (None, []) and got == want


def small_pairs():
    ids = list(range(256))
    return bpe.BytePairs(ids, {(97, 98): (0, 300), (300, 300): (1, 301), (98, 97): (2, 302), (302, 302): (3, 303), (300, 99): (4, 304)})


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=30))
def test_merge_order(word):
    names = {i: chr(i) for i in range(256)} | {300: "ab", 301: "abab", 302: "ba", 303: "baba", 304: "abc"}
    vocab = {v: k for k, v in names.items()}
    ranks = {("a", "b"): 0, ("ab", "ab"): 1, ("b", "a"): 2, ("ba", "ba"): 3, ("ab", "c"): 4}
    assert small_pairs().merge(word) == plain_merge(word, vocab, ranks)


def test_lists_of_words_with_nulls(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 1)
    words = pa.array([["ab", "abab"], None, [], ["c", "abab"]], pa.list_(pa.string()))
    p = small_pairs()
    for part, want in ((words, [[300, 301], [], [], [99, 301]]), (words.slice(3), [[99, 301]]), (words.slice(0, 0), [])):
        assert bpe.list_ids(part, p).to_pylist() == want


def test_pieces_of_a_chat(spark):
    turns = [{"role": "user", "value": "<image>\nQ <image>"}, {"role": "assistant", "value": "A"}]
    x = spark.createDataFrame([(1, True, turns), (2, False, turns), (3, True, [])], "k long, img boolean, turns array<struct<role:string,value:string>>")
    x = x.withColumn("p", Q.chat_pieces(F.col("turns"), F.col("img"))).withColumn("t", F.transform("p", lambda p: F.transform(F.filter(F.split(p["text"], ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))))
    ids, labels = Q.assembled(F.col("p"), F.col("t"))
    code = lambda t: [ord(c) for c in t]
    user, answer = code("<|im_start|>user\n"), code("<|im_start|>assistant\n")
    end = code("<|im_end|>\n")
    for k, a, b in x.select("k", ids, labels).collect():
        if k == 3:
            assert (a, b) == ([], [])
            continue
        body = [-200, *code("\nQ "), -200] if k == 1 else code("<image>\nQ <image>")
        assert a == user + body + end + answer + code("A") + end
        assert b == [-100] * len(user + body + end + answer) + code("A") + end


# --- splice ---


@pytest.mark.parametrize("limit", [splice.BROADCAST_BYTES, 0])
def test_rows_of_a_batch(spark, limit):
    table = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(5)] + [(3, [3.0, -3.0])], "id long, vector array<float>")
    samples = spark.createDataFrame([(1, [1, -200, 2], [-100, -100, 2]), (2, [4, 9, None], [4, 9, 9]), (3, [], []), (4, None, None), (5, [-200], [-100]), (6, [3] * 6, [3] * 6)], "k long, input_ids array<long>, labels array<long>")
    images = spark.createDataFrame([(1, [[7.0, 7.0], [8.0, 8.0], [9.0, 9.0]]), (6, [[1.0, 1.0]])], "k long, features array<array<float>>")
    x = splice.spliced(samples, table, images, "k", 2, 2, limit=limit, shares=3)
    got = {r["k"]: (r["rows"], r["labels"]) for r in x.collect()}
    assert got[1] == ([[1, -1], [7, 7], [8, 8], [2, -2]], [-100, -100, -100, 2])
    assert got[2] == ([[4, -4], [0, 0], [0, 0]], [4, 9, 9])  # an id that the table lacks, and none
    assert got[3] == got[4] == ([], []) and got[5] == ([[0, 0], [0, 0]], [-100, -100]) and got[6] == ([[3, -3]] * 6, [3] * 6)
    even = {r["k"]: r for r in splice.padded_rows(x.withColumn("b", F.lit(0)), "b", 2).collect()}
    assert {len(r["rows"]) for r in even.values()} == {len(r["labels"]) for r in even.values()} == {6}
    assert even[1]["rows"][4:] == [[0, 0], [0, 0]] and even[1]["labels"][4:] == [-100, -100] and even[1]["attention_mask"] == [1, 1, 1, 1, 0, 0]


def test_two_images_are_an_error(spark):
    samples = spark.createDataFrame([(1, [-200, -200], [-100, -100])], "k long, input_ids array<long>, labels array<long>")
    none = spark.createDataFrame([], "k long, features array<array<float>>")
    with pytest.raises(Exception, match="more than one image"):
        splice.spliced(samples, spark.createDataFrame([], "id long, vector array<float>"), none, "k", 2, 2).collect()


def test_large_tables_are_not_broadcast(spark):
    table = spark.createDataFrame([(1, [1.0])], "id long, vector array<float>")
    places = spark.range(10).selectExpr("id AS k", "id % 3 AS id")
    plan = splice.token_rows(places, table, 1, limit=0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


# --- loss logs ---

START = dt.datetime(2024, 1, 1)


def plain_losses(rows, patience):
    """(n_train, n_eval, best_step, best_loss, stop_step) of rows (minute, step, loss, eval); the latest row of a step counts."""
    last = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        last[r[1]] = r
    evals = [(s, e) for _, s, _, e in last.values() if e is not None]
    stop, best, since = None, None, 0
    for s, e in evals:
        if best is None or e < best:
            best, since = e, 0
        else:
            since += 1
            if since == patience and stop is None:
                stop = s
    return sum(r[2] is not None for r in last.values()), len(evals), min(evals, key=lambda x: (x[1], x[0]))[0] if evals else None, best, stop


def log_rows(rng, n):
    out = []
    for step in range(n):
        value = round(rng.uniform(0, 3), 1)
        out.append((step, step, None, value) if step % 3 == 0 else (step, step, value, None))
        if rng.random() < 0.2:
            out.append((step + 2, step, None, value / 2) if step % 3 == 0 else (step + 2, step, value / 2, None))
    return out


@pytest.mark.parametrize("patience", [1, 3])
def test_stream_of_losses(spark, patience):
    rng = random.Random(patience)
    logs = {f"r{k}": log_rows(rng, n) for k, n in enumerate((80, 40, 1, 2))}
    arrivals = sorted(((m + rng.randint(0, 6), run, m, *rest) for run, rows in logs.items() for m, *rest in rows), key=lambda x: x[0])
    arrivals += [(100, None, 90, 1, 1.0, None), (100, "r1", 90, None, 1.0, None)]
    source, out, schema = fresh_path(spark, "log"), fresh_path(spark, "out"), "run string, at timestamp, step long, loss double, eval_loss double"
    states = []
    for part in (arrivals[:50], arrivals[50:52], arrivals[52:110], arrivals[110:]):
        spark.createDataFrame([(run, START + dt.timedelta(minutes=m), s, a, b) for _, run, m, s, a, b in part], schema).write.mode("append").json(source)
        lines = spark.readStream.schema(schema).json(source)
        q = losses.follow(lines, "20 minutes", patience).writeStream.outputMode("update").foreachBatch(lambda rows, n: committed.commit(rows, n, out) and None)
        q = q.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        states += [s["memoryUsedBytes"] for p in q.recentProgress for s in p["stateOperators"]]
    rows = committed.read_committed(spark, out, losses.RESULT).groupBy("run").agg(F.max_by(F.struct("n_train", "n_eval", "best_step", "best_loss", "stop_step"), "batch").alias("r")).collect()
    assert {r["run"]: tuple(r["r"]) for r in rows} == {run: plain_losses(log, patience) for run, log in logs.items()}


def test_fold_in_parts_is_fold_of_all():
    rng = random.Random(7)
    rows = [(m, s, a, b) for m, s, a, b in log_rows(rng, 60)]
    whole = losses.fold(losses.NOTHING, rows, 2)
    for cut in range(0, 60, 7):
        parts = losses.fold(losses.fold(losses.NOTHING, [r for r in rows if r[1] < cut], 2), [r for r in rows if r[1] >= cut], 2)
        assert parts == whole


@pytest.mark.parametrize("patience", [1, 2, 4])
def test_results_of_blocks_are_those_of_the_run(spark, patience):
    rng, parts, want = random.Random(patience), [], {}
    for k in range(60):
        rows = [(s, s, None, float(rng.randint(0, 9) + (60 - s) * (k % 3) / 9)) if rng.random() < 0.7 else (s, s, 1.0, None) for s in range(-6, rng.randint(-5, 50))]
        want[f"r{k}"] = plain_losses(rows, patience)
        # blocks of four steps, some far apart, each with a result of an earlier batch
        for block in {r[1] >> 2 for r in rows}:
            own = [r for r in rows if r[1] >> 2 == block]
            for batch, some in enumerate((own[:1], own)):
                n_train, n_eval, best, loss, since, stop, *first = losses.fold(losses.NOTHING, some, patience)
                parts.append((f"r{k}", n_train, n_eval, best, loss, stop, block << (k % 2 * 40), since, *map(list, first), batch))
    got = losses.results(spark.createDataFrame(parts, f"{losses.PART}, batch long"), patience).collect()
    assert {r["run"]: tuple(r)[1:] for r in got} == want


def test_a_run_is_kept_in_blocks_of_steps(spark):
    rows = [("r", START + dt.timedelta(minutes=k), step, None, loss) for k, (step, loss) in enumerate([(0, 3.0), (1 << losses.BLOCK, 4.0), (70_000, 2.0), (200_000, 5.0), (300_000, 6.0)])]
    schema = "run string, at timestamp, step long, loss double, eval_loss double"
    source, out = fresh_path(spark, "log"), fresh_path(spark, "out")
    spark.createDataFrame(rows, schema).write.json(source)
    q = losses.follow(spark.readStream.schema(schema).json(source), "20 minutes").writeStream.outputMode("update").foreachBatch(lambda rows, n: committed.commit(rows, n, out) and None)
    q.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    parts = committed.read_committed(spark, out, losses.PART)
    assert sorted(r["block"] for r in parts.select("block").distinct().collect()) == [0, 1, 3, 4]
    assert [tuple(r) for r in losses.results(parts).collect()] == [("r", 0, 5, 70_000, 2.0, 300_000)]


def test_steps_count_in_any_order_of_times(spark):
    # step 5 is long settled when steps 1 and 3, older by number, come in time; step 5 then comes once more and is not counted
    arrivals = [[(0, 5, None, 2.0), (0, 6, 1.0, None)], [(500, 40, None, 4.0)], [(1000, 1, None, 3.0), (1001, 3, None, 3.5), (1000, 5, None, 0.1), (1000, 6, 9.0, None), (1002, 2, 1.0, None)]]
    source, out, schema = fresh_path(spark, "log"), fresh_path(spark, "out"), "run string, at timestamp, step long, loss double, eval_loss double"
    for part in arrivals:
        for again in (part, part[:1]):  # a state settles steps when rows of its block come
            spark.createDataFrame([("r", START + dt.timedelta(minutes=m), *rest) for m, *rest in again], schema).write.mode("append").json(source)
            q = losses.follow(spark.readStream.schema(schema).json(source), "20 minutes").writeStream.outputMode("update").foreachBatch(lambda rows, n: committed.commit(rows, n, out) and None)
            q.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = losses.results(committed.read_committed(spark, out, losses.PART)).collect()
    assert [tuple(r) for r in got] == [("r", 2, 4, 5, 2.0, None)]


def test_rows_of_one_time_count_alike_in_any_order():
    rows = [(5, 1, 2.0, None), (5, 1, None, 1.0), (5, 1, None, 3.0), (4, 1, None, 9.0), (5, 1, None, None)]
    for k in range(len(rows)):
        held = {}
        losses.keep_latest(held, rows[k:] + rows[:k])
        assert held == {1: (5, 1, None, 3.0)}


# --- appends ---


def test_failed_batches_are_replayed(spark):
    source, out = fresh_path(spark, "arrivals"), fresh_path(spark, "appended")
    lost = set()

    def breaks(batch):
        if batch not in lost:
            lost.add(batch)
            raise OSError("lost")

    def run():
        rows = spark.readStream.schema("k long, v string").json(source)
        return committed.append_once(rows, lambda x: x.withColumn("n", F.lit(1)), out, "k", breaks)

    read = []
    for part in range(4):
        # each arrival has its own rows, an earlier row again, and one row twice
        spark.createDataFrame([(k, "x") for k in range(part * 10, part * 10 + 10)] + [(0, "again"), (part * 10 + 1, "x")], "k long, v string").write.mode("append").json(source)
        with pytest.raises(StreamingQueryException):
            run().awaitTermination()
        before = committed.read_committed(spark, out, "k long, v string, n int").count()
        assert before == part * 10  # what was written without an entry is not read
        q = run()
        q.awaitTermination()
        read += [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    rows = committed.read_committed(spark, out, "k long, v string, n int")
    assert sorted((r["k"], r["batch"]) for r in rows.collect()) == [(k, k // 10) for k in range(40)]
    assert read == [12] * 4  # a batch reads its own rows, not what was written before
    assert not committed.commit(rows.drop("batch"), 2, out) and rows.count() == 40  # a batch that is in the log is not written again


def test_nothing_is_committed(spark):
    assert committed.read_committed(spark, fresh_path(spark, "none"), "k long").collect() == []


def test_byte_names_are_distinct():
    names = bpe.byte_names()
    assert len(set(names)) == 256 and names[32] == "Ġ" and names[ord("a")] == "a" and np.all([len(c) == 1 for c in names])
