"""Top-k, url rules, WARC, sharding, pipeline."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import registry, warc
from loomframe.llm.sharding import interleave, op10_sharding
from loomframe.llm.topk import Lists, op4_top_k, top_k
from loomframe.llm.url_filter import RULES, Cascade, judge_urls, op6_url_filters


def best(rows, q, k):
    v = dict(rows)[q]
    s = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q), key=lambda x: x)[:k]
    return [(r + 1, i, -x) for r, (x, i) in enumerate(s)]


def test_top_k_with_ties(spark, tables):
    rng = random.Random(1)
    raw = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(6)], 0) for i in range(400)] + [(1000 + i, [0.5] * 6, 0) for i in range(30)]
    odd = [(500, None, 0), (550, [0.1, None, 0, 0, 0, 0], 0), (600, [math.nan] * 6, 0), (650, [math.inf] * 6, 0), (None, [0.1] * 6, 0), (750, [0.0] * 6, 0), (800, [1.0, 2.0], 0), (801, [1.0, 1.0], 0)]
    got = defaultdict(list)
    for r in op4_top_k(spark, tables(embeddings=raw + odd)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    q = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    rows = [(i, q(v)) for i, v, _ in raw] + [(750, [0] * 6)]
    for i in [i for i, _ in rows if i % 50 == 0]:
        assert sorted(got.pop(i)) == best(rows, i, 5)
    assert sorted(got.pop(800)) == [(1, 801, 256 * 256 + 512 * 256)] and not got
    assert op4_top_k(spark, tables()).count() == 0


def test_blocks_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-9, 9) for _ in range(5)]) for i in range(300)]
    c = spark.createDataFrame(rows, "vec_id long, v array<long>")
    q = c.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")
    one, many = (sorted(map(tuple, top_k(c, q, 4, *b).collect())) for b in ((1000, 1000), (37, 4)))
    assert one == many


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    rows = rng.integers(-5, 6, (5000, 8))
    rows[7] = 200 * np.sign(rows[8] + 0.5)
    lists = Lists(np.arange(5000), rows)
    score, ids = lists.top(rows[7], 1, own=-1)
    assert ids.tolist() == [7] and score[0] == 200 * 200 * 8
    big = Lists(np.arange(3), np.array([[2**40], [2**41], [-(2**41)]]))
    assert big.top(np.array([2**20]), 1, own=-1)[0].tolist() == [2**61]


def test_scores_near_and_beyond_64_bits(spark, tables):
    """Products that wrap in 64 bits are reckoned whole; what a long cannot hold is an error."""
    rows = np.array([[2**40, 2**40], [2**40, -(2**40)], [-(2**40), 5]])
    lists = Lists(np.arange(3), rows)
    with pytest.raises(ValueError):
        lists.top(np.array([2**40, 0]), 1, own=-1)
    score, ids = lists.top(np.array([2**40, 2**40]), 1, own=0)
    assert ids.tolist() == [1] and score.tolist() == [0]
    with pytest.raises(ValueError):
        lists.top(np.array([2**22, 2**22]), 1, own=-1)
    score, ids = lists.top(np.array([2**22, 2**22 - 1]), 1, own=-1)
    assert ids.tolist() == [0] and score.tolist() == [2**63 - 2**40]
    assert lists.top(np.array([2**22, 2**22 - 1]), 3, own=0)[0].tolist() == [2**40, -(2**62) + 5 * (2**22 - 1)]
    for big in (3e38, 3e34):
        with pytest.raises(Exception, match="too large"):
            op4_top_k(spark, tables(embeddings=[(0, [big, 1.0], 0), (1, [big, 1.0], 0), (2, [-big, 1.0], 0)])).collect()
    small = [(0, [1e12, 1.0], 0), (1, [-1e12, 1.0], 0), (2, [0.0, 1.0], 0)]
    got = [(r["vec_id"], r["score"]) for r in op4_top_k(spark, tables(embeddings=small[:1] + small[2:])).collect()]
    assert got == [(2, 65536)]


URLS = [
    (1, "http://a.example.org/es/x"), (2, "https://EXAMPLE.org/en/1?y"), (3, "http://example.org/en/2"), (4, "http://notexample.org/es/"), (5, "http://x.com/fr/1"), (6, "http://x.com/de/1#f"), (7, "http://x.net/fr/"), (8, None), (9, "no scheme"), (10, ""),
    (11, "http://org"), (12, "http://org/"), (13, "http://com/fr/"), (14, "http://a.com?/fr/"), (15, "://b.org/"), (16, "http://x.com/FR/1"), (17, "http://http://x.org/"), (18, "http://é.org/\n/x"), (1, "http://a.example.org/es/x"), (None, "http://q.com/de/"), (19, "http://." * 40 + "org/"),
]


def judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:n].translate(brute.LOW)
    path = rest[n:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(p), p, v) for v, p in RULES if (host == p.split("/")[0] or host.endswith("." + p.split("/")[0])) and path.startswith(p[p.index("/") :])]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark, tables):
    got = op6_url_filters(spark, tables(pages=[(i, u, "h") for i, u in URLS])).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *judge(u)) for i, u in URLS), key=key)
    assert op6_url_filters(spark, tables()).count() == 0


def test_cascade_is_exact_with_many_levels(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key in ('k1', 'k2') OR pmod(xxhash64(key), 3) = 0")
    c = Cascade.build(listed, universe)
    assert len(c.levels) > 3
    want = {r["key"] for r in listed.collect()}
    assert {r["key"] for r in universe.where(c.holds(F.col("key"))).collect()} == want
    split = Cascade.build(listed, universe, max_bits=8192)
    assert len(split.parts) > 1 and not split.levels
    assert {r["key"] for r in universe.where(split.holds(F.col("key"))).collect()} == want
    assert judge_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), []).first()["verdict"] == "allow"


def test_warc_round_trip(spark, tables):
    big = "x" * (17 << 20)
    pages = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://b/\nz", "same"), (4, "http://c/", None), (5, "http://d/", ""), (6, "http://é/", "üñ\r\n\r\nWARC/1.1"), (0, "http://e/", "zero"), (7, "u", "zero"), (8, "http://f/", big), (9, "http://g/", "\0")]
    got = {r["page_id"]: r for r in warc.op9_warc(spark, tables(pages=pages)).collect()}
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(i, last.get(h or "", -1))
    assert len(got) == len(pages)
    for i, _, h in pages:
        data, ref = (h or "").encode(), last[h or ""]
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if ref == i else "revisit", None if ref == i else ref, True)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["digest_ok"]) == want
    assert warc.op9_warc(spark, tables()).count() == 0


def test_archives_are_gzip_files_with_a_member_a_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", bytearray(b"p%d" % i), None) for i in range(5)], "page_id long, url string, payload binary, refers_to long")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 5
    members = list(warc.read_members(iter([data[i : i + 7] for i in range(0, len(data), 7)])))
    assert len(members) == 5 and all(m.startswith(b"WARC/1.1") and m.endswith(b"\r\n\r\n") for m in members)
    assert [r["payload"] for r in warc.read_archives(spark, str(tmp_path / "w")).orderBy("page_id").collect()] == [b"p%d" % i for i in range(5)]


def test_reader_sees_damage():
    good = warc.record(1, "http://x/", b"abc", None)
    list(warc._records(warc.member(good), True))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_members(iter([warc.member(good)[:-9]])))
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parse(good.replace(b"abc", b"abcd"))
    assert [r[-2] for r in warc._records(warc.member(good.replace(b"abc", b"abd")), True)] == [False]


def test_sharding(spark, tables, edge_documents):
    rng = random.Random(5)
    docs = [*edge_documents, *[(100 + i, f"t{i}", "en", rng.choice(["hot", "hot", "hot", "a", "b", None]), 1) for i in range(2500)]]
    folder = tables(documents=docs)
    got = op10_sharding(spark, folder).collect()
    assert len(got) == len(docs)
    n = Counter(r["shard"] for r in got)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = Counter(r["source"] for r in got)
    for s, k in total.items():
        each = Counter(r["shard"] for r in got if r["source"] == s)
        assert all(abs(each[j] - k / 40) <= 2 for j in range(40))
    text = {i: t for i, t, *_ in docs if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            t = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(t) + 16, zlib.crc32(t))
    again = sorted(map(str, op10_sharding(spark, folder).collect()))
    assert again == sorted(map(str, got))
    assert op10_sharding(spark, tables()).count() == 0


def test_few_rows_and_many_buckets(spark, monkeypatch):
    from loomframe.llm import sharding

    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)
    monkeypatch.setattr(sharding, "FINE", 3)
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"))
    got = interleave(df, "s", ["id"], 8).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [125] * 8
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["frac_rank"] for r in order] == sorted(r["frac_rank"] for r in got)
    assert [r["shard"] for r in interleave(df.limit(3), "s", ["id"], 8).orderBy("shard").collect()] == [0, 2, 5]


# pipeline


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_pipeline_against_plain_stages(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    import corpus_pipeline
    from loomframe.llm.pieces import MODEL
    from loomframe.llm.toxicity import op7_toxicity

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    clean = {r["doc_id"] for r in op7_toxicity(spark, sf).where("predicted = 0").collect()}
    rows = sorted((i, t) for i, t in docs.items() if i in clean)
    rows = [(i, t) for i, t in rows if brute_component[i][1] == i] if (brute_component := brute.near_duplicates(rows, 5, 80)) else []
    rows = brute.drop_repeats(rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(i, t) for (i, t), c in zip(rows, brute.contamination([t for _, t in rows], items)) if not c[4]]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert got == {i: library.encode(t) for i, t in rows}


def test_stages_keep_columns_and_odd_rows(spark, tables, edge_documents):
    import corpus_pipeline

    folder = tables(documents=edge_documents, benchmark=[(1, "nothing to be found in any of these few documents at all my friend")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, folder)
        assert docs.columns == names, name
        assert 0 < docs.count() <= before
    assert stage_last(spark, docs, folder) == docs.count()
    empty = tables()
    none = spark.read.parquet(f"{empty}/documents.parquet")
    assert all(stage(spark, none, empty).count() == 0 for _, stage in corpus_pipeline.STAGES)


def stage_last(spark, docs, folder):
    import corpus_pipeline

    return corpus_pipeline.STAGES[-1][1](spark, docs, folder).count()


@pytest.mark.parametrize("name", ["op3_minhash", "op5_decontamination", "op8_suffix_dedup", "op9_warc", "op10_sharding", "op12_prefix_trie", "op13_fill_in_middle"])
def test_sql_gives_the_same_rows(spark, tables, edge_documents, name):
    """Over odd rows; ids are distinct and not null, as SQL joins by them."""
    docs = [(k, *r[1:]) for k, r in enumerate(edge_documents)]
    pages = [(k, "http://a/", t) for k, (_, t, *_) in enumerate(docs)]
    folder = tables(documents=docs, pages=pages, benchmark=[(1, docs[0][1][:300]), (2, "one"), (3, None)], conversations=[(k // 3, k % 3 or None, r[2], r[1]) for k, r in enumerate(docs)])
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, folder)
    names = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want, key=repr)
