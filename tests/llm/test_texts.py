"""Near duplicates, repeated passages, contamination and pieces against brute force or the library."""

import hashlib
import random
import secrets
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import minhash, repeats
from loomframe.llm.common import run_hash, shared_dir, wide_hashes
from loomframe.llm.decontaminate import Windows, find_passages, op5_decontamination, remove_spans, word_hashes
from loomframe.llm.fm_index import FMIndex
from loomframe.llm.graph import components
from loomframe.llm.minhash import drop_near_duplicates, near_duplicates, op3_minhash
from loomframe.llm.pieces import MODEL, Cutter, Dictionary, Pieces, best_path, decode, encode, merge_word, op2_sentencepiece, word_hash
from loomframe.llm.repeats import drop_repeats, op8_suffix_dedup, repeated_windows
from loomframe.llm.suffix import suffix_order


def test_run_hash_depends_on_bytes_only():
    a, b = np.frombuffer(b"xxabcdyy", np.uint8), np.frombuffer(b"abcd", np.uint8)
    assert run_hash(a, np.array([2]), np.array([6])) == run_hash(b, np.array([0]), np.array([4]))
    assert run_hash(a, np.array([2]), np.array([5])) != run_hash(b, np.array([0]), np.array([4]))


def test_hashes_tell_thue_morse_texts_apart():
    """A text of two letters and its complement, which polynomial hashes modulo a power of two cannot tell apart."""
    a = bytes(97 + i.bit_count() % 2 for i in range(4096))
    b = bytes(195 - c for c in a)
    data = np.frombuffer(a + b, np.uint8)
    for n in (8, 64, 400, 1024, 4096):
        x, y = run_hash(data, np.array([0, 4096]), np.array([n, 4096 + n]))
        assert x != y
        w = wide_hashes(data, n)
        assert w[0] != w[4096] and len(w) == len(data) - n + 1
    assert len({*word_hash([a[:1024].decode(), b[:1024].decode()]).tolist()}) == 2


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_equal_ranges_have_equal_hashes(letters, n):
    data = np.array(letters, np.uint8)
    start = np.arange(max(0, len(data) - n + 1))
    h = run_hash(data, start, start + n)
    for i in start:
        for j in start:
            assert (h[i] == h[j]) == (data[i : i + n].tobytes() == data[j : j + n].tobytes())


# near duplicates


def near_copies(rng, n):
    """Copies with a few edits each, and texts that share half their words."""
    rows, at = [], 0
    for _ in range(n):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.randint(1, 5)):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 15))):
                v[rng.randrange(len(v))] = f"e{rng.randint(0, 99)}"
            rows.append((at, " ".join(v)))
            at += 1
        rows.append((at, " ".join(w[: len(w) // 2] + [f"z{rng.randint(0, 999)}" for _ in range(len(w) // 2)])))
        at += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, tables, seed):
    rows = near_copies(random.Random(seed), 40)
    want = brute.near_duplicates(rows, 3, 85)
    got = {r["doc_id"]: r for r in op3_minhash(spark, tables(documents=[(i, t, "en", "s", 1) for i, t in rows])).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_components_of_a_source_that_changes_its_answer(spark):
    """Each group of three comes as one of its spanning trees, another at each evaluation; the components are the same."""

    def run(batches):
        for batch in batches:
            out = []
            for g in batch.column(0).to_pylist():
                x, y, z = 3 * g, 3 * g + 1, 3 * g + 2
                out += secrets.choice([[(x, y), (x, z)], [(z, y), (y, x)], [(y, z), (y, x)]])
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]})

    edges = spark.range(60).repartition(3).mapInArrow(run, "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == [(k, k - k % 3) for k in range(180)]


def test_groups_do_not_depend_on_partitions(spark, monkeypatch):
    """A group in many blocks, over several partitionings, against brute force."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(11)
    rows = near_copies(rng, 40) + [(900, ""), (901, None)]
    want = {i: c for i, (_, c) in brute.near_duplicates(rows, 5, 80).items()}
    rng.shuffle(rows)
    for n in (1, 3, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == want


def test_one_id_with_two_texts_is_one_vertex(spark):
    a, b = (" ".join(f"{w}{k}" for k in range(40)) for w in "ab")
    rows = [(2, a + " x"), (5, a), (5, b), (9, b + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()} == {(2, 2), (5, 2), (9, 2)}


def test_chain_of_links_is_one_component(spark):
    """Neighbours are similar, ends are not: no single member is close to all."""
    w = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*(f"v{j}" for j in range(6 * k)), *w[6 * k :]])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows, 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()} == want
    assert {c for _, c in want.values()} == {0}


def test_near_duplicates_edges(spark, tables, edge_documents):
    got = op3_minhash(spark, tables(documents=edge_documents)).collect()
    assert len(got) == len(edge_documents)
    want = brute.near_duplicates([(i, t) for i, t, *_ in edge_documents], 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert op3_minhash(spark, tables()).count() == 0


def test_circulant_estimates_jaccard():
    rng = np.random.default_rng(0)
    c = minhash.Circulant(600)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 100, 100))
    same = (c(np.concatenate([common, a])) == c(np.concatenate([common, b]))).mean()
    assert abs(same - 300 / 500) < 0.08


def test_stage_leaves_one_row_of_each_group(spark, edge_documents):
    """Rows, not ids: repeated ids, rows without an id and two texts under one id."""
    base = edge_documents[0][1]
    rng = random.Random(4)
    own = [" ".join(f"u{rng.randint(0, 9999)}" for _ in range(40)) for _ in range(3)]
    rows = [*[(i, t) for i, t, *_ in edge_documents], (30, own[0]), (30, base + " more"), (None, own[1]), (None, own[1]), (31, own[2]), (31, own[2]), (None, own[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    groups = {}
    for k, (_, c) in brute.near_duplicates([(k, t) for k, (_, t) in enumerate(rows)], 5, 80).items():
        groups.setdefault(c, []).append(k)
    got = drop_near_duplicates(spark, docs, "").collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in got)) == sorted(key(min(g, key=key)) for g in groups.values())
    assert all(rows[r["n_chars"]] == (r["doc_id"], r["text"]) for r in got)
    assert sum((r["text"] or "").startswith(base[:200]) for r in got) == 1 and {(30, own[0]), (None, own[1]), (31, own[2])} <= {(r["doc_id"], r["text"]) for r in got}


# repeated passages


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_order(t):
    t = [*t, 0]
    assert suffix_order(t) == sorted(range(len(t)), key=lambda i: t[i:])


def passages(rng, n, width):
    """Texts of few letters with planted passages around the width, edits and overlaps."""
    bank = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([width - 1, width, width + 1, 3 * width]))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(bank)
            if rng.random() < 0.5:
                i = rng.randrange(len(p))
                p = p[:i] + rng.choice("XYZ") + p[i + 1 :]
            parts += [p, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60)))]
        out.append("".join(parts))
    return out


def test_passages_of_op8(spark, tables):
    """has_passage tells of 51 repeated words in under 400 bytes; the bytes stay."""
    rng = random.Random(12)
    say = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 9999)}" for _ in range(n))
    p, q = say(51), say(50)
    rows = [(0, f"{say(9)} {p} {say(9)}"), (1, f"{p}\n{say(3)}"), (2, f"{say(4)} {q}"), (3, f"{q} {say(4)}"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in op8_suffix_dedup(spark, tables(documents=[(i, t, "en", "s", 1) for i, t in rows])).collect()}
    assert {i: (r["n_removed"], r["has_passage"], r["n_passages"], r["passage_bytes"]) for i, r in got.items()} == {i: (0, i < 2, int(i < 2), len(p) * (i < 2)) for i in range(6)}


def check_repeats(rows, got, width):
    want = brute.repeats([t for _, t in rows], width)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    a = sorted(((i, *w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(rows, want)), key=key)
    b = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=key)
    assert a == b


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, tables, seed):
    rows = list(enumerate(passages(random.Random(seed), 40, 400)))
    check_repeats(rows, op8_suffix_dedup(spark, tables(documents=[(i, t, "en", "s", 1) for i, t in rows])).collect(), 400)


def test_counted_contexts_give_the_same(spark, tables, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)
    rows = list(enumerate(passages(random.Random(5), 40, 400)))
    check_repeats(rows, op8_suffix_dedup(spark, tables(documents=[(i, t, "en", "s", 1) for i, t in rows])).collect(), 400)


def test_repeats_edges(spark, tables, edge_documents):
    rows = [(i, t) for i, t, *_ in edge_documents]
    check_repeats(rows, op8_suffix_dedup(spark, tables(documents=edge_documents)).collect(), 400)
    assert op8_suffix_dedup(spark, tables()).count() == 0


def test_copies_without_an_id_are_asked_once(spark, tables):
    """Thousands of rows with one text and no id, and a text that shares a part: a row's contexts are cut from that row alone."""
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    part = say(450)
    text, other = part + say(300), say(200) + part
    rows = [(None, text)] * 10_000 + [(1, other), (2, say(900))]
    folder = tables(documents=[(i, t, "en", "s", 1) for i, t in rows])
    got = op8_suffix_dedup(spark, folder).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["count"]) for r in got) == [(0, 750, 750, 1, 10_000), (1, 650, 450, 1, 1), (2, 900, 0, 0, 1)]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    written = []
    keep, repeats.materialize = repeats.materialize, lambda df, name: written.append((name, out := keep(df, name))) or out
    try:
        repeats.without_repeats(docs, ["doc_id"], repeats.Bytes(400)).count()
    finally:
        repeats.materialize = keep
    assert dict(written)["bytes"].count() < 20


def test_only_spans_of_passages_stay(spark, tables, edge_documents, monkeypatch):
    """The tables behind the spans are gone before the texts are shuffled again, and those hold a text once."""
    docs = spark.read.parquet(f"{tables(documents=edge_documents)}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    folder, seen, without = Path(shared_dir(spark).removeprefix("file:")), [], repeats.without_repeats
    monkeypatch.setattr(repeats, "without_repeats", lambda docs, *more, **named: seen.append(docs.schema) or without(docs, *more, **named))
    before = set(folder.iterdir())
    out = drop_repeats(spark, docs, "")
    assert {p.name.split("-")[0] for p in set(folder.iterdir()) - before} == {"files", "spans"}
    assert seen[0].simpleString().count("text:string") == 1
    assert sum(r["text"] is None for r in out.collect()) == sum(r[1] is None for r in edge_documents)


def test_long_texts_in_pieces(spark, tables, monkeypatch):
    rng = random.Random(6)
    p = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows = [(0, p + "x" * 50 + p), (1, "q" + p[100:900])]
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    check_repeats(rows, op8_suffix_dedup(spark, tables(documents=[(i, t, "en", "s", 1) for i, t in rows])).collect(), 400)


def test_repeated_windows_need_left_and_right():
    rng = random.Random(0)
    core = bytes(rng.randrange(97, 123) for _ in range(900))
    texts = [core[:500], b"#" * 10 + core[10:480] + b"!" * 30, core[200:700]]
    got = repeated_windows(texts, [100, 100, 900 - 200 + 100], 400)
    assert got[0].tolist() == list(range(10, 81)) and got[1].tolist() == list(range(10, 81)) and not len(got[2])


def drop(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"]: r["text"] for r in drop_repeats(spark, docs, "").collect()}


def test_stage_takes_passages_of_51_words(spark):
    """51 words of under 400 bytes go from every text that holds them; 50 words stay."""
    rng = random.Random(11)
    say = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 9999)}" for _ in range(n))
    p, q = say(51), say(50)
    assert len(p) < 400
    a, b, c, d, e = (say(20) for _ in range(5))
    rows = [(0, f"{a} {p} {b}"), (1, f"{p}\n{c}"), (2, f"{d} {q} {e}"), (3, f"{a[:9]}x {q}"), (4, c[:40])]
    got = drop(spark, rows)
    assert got == {0: f"{a}  {b}", 1: f"\n{c}", 2: rows[2][1], 3: rows[3][1], 4: rows[4][1]}


@pytest.mark.parametrize(("seed", "hot", "segment"), [(1, 8192, 4 << 20), (2, 2, 4 << 20), (3, 8192, 600)])
def test_stage_matches_brute_force(spark, monkeypatch, seed, hot, segment):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rng = random.Random(seed)
    bank = [[rng.choice(["é", "a", "to", "word", "x1", "under,"]) for _ in range(rng.choice([50, 51, 52, 90, 160]))] for _ in range(6)]
    bank.append(["ab", "cd"] * 60)
    rows = []
    for i in range(40 if segment > 600 else 1):
        parts = []
        for _ in range(rng.randint(0, 4) if segment > 600 else 12):
            w = list(rng.choice(bank))
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = f"E{rng.randint(0, 99)}"
            parts += [" ".join(w), *(f"own{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 20)))]
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    want = {i: t for (i, old), t in zip(rows, brute.plain_passages([t for _, t in rows])) if t or not old}
    assert drop(spark, rows) == want and any(want.get(i) != t for i, t in rows)


# contamination


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    t = rng.integers(1, 5, 500)
    fm = FMIndex(t, 5, sample=7)
    patterns = rng.integers(1, 5, (60, 4))
    lengths = rng.integers(1, 5, 60)
    lo, hi = fm.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, lo, hi):
        want = [i for i in range(len(t) - n + 1) if (t[i : i + n] == p[:n]).all()]
        assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


def test_contamination_matches_brute_force(spark, tables):
    rng = random.Random(7)
    bank = [f"w{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(bank) for _ in range(n))
    items = [(i, say(rng.choice([1, 5, 13, 14, 40]) if i < 20 else 30)) for i in range(25)]
    items = [x for x in items if len(x[1].split()) > 4] + [(3, items[5][1]), (None, say(20)), (50, None), (51, ""), (52, "!!! ...")]
    docs = []
    for i in range(60):
        parts = [say(rng.randint(0, 40))]
        if rng.random() < 0.6:
            w = rng.choice([t for _, t in items if t]).upper().split()
            a = rng.randrange(len(w))
            parts += ["; ".join(w[a : a + rng.choice([12, 13, 20])]), say(rng.randint(0, 300))]
        docs.append((i, " ".join(parts), "en", "s", 1))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in op5_decontamination(spark, tables(documents=docs, benchmark=items)).collect()}
    want = dict(zip([d[0] for d in docs], brute.contamination([d[1] for d in docs], items)))
    assert got == want and any(w[4] for w in want.values()) and not all(w[4] for w in want.values())
    # many blocks of the benchmark give what one does
    d = spark.createDataFrame([(x[0], x[1]) for x in docs], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one, more = ({r["doc_id"]: (r["words"], r["spans"], r["items"]) for r in find_passages(d, b, ["doc_id"], block=k).collect()} for k in (1 << 20, 200))
    assert one == more


def test_contamination_edges(spark, tables, edge_documents):
    items = [(1, edge_documents[0][1][:300]), (2, "one"), (3, "漢字 かな")]
    got = op5_decontamination(spark, tables(documents=edge_documents, benchmark=items)).collect()
    want = brute.contamination([t for _, t, *_ in edge_documents], items)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=key) == sorted(((d[0], *w) for d, w in zip(edge_documents, want)), key=key)
    assert all(r["n_hit"] == 0 for r in op5_decontamination(spark, tables(documents=edge_documents)).collect())
    assert op5_decontamination(spark, tables()).count() == 0


def test_spans_cut_whole_words():
    w = Windows([("a", "one two three")])
    text = "x One, TWO three y".encode()
    h, start, end, row = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    at, _ = w.occurrences(h, row)
    assert at.tolist() == [1] and remove_spans(text.decode(), [(int(start[1]), int(end[3]))]) == "x  y"


# pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_are_the_librarys(spark, tables, edge_documents, library):
    rng = random.Random(8)
    odd = ["".join(rng.choice("aAbBeE1 .,-_\n▁é漢/😀") for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["e" * 300, "aaaabbbb" * 40, "=" * 130]
    docs = [*edge_documents, *[(100 + i, t, "en", "s", 1) for i, t in enumerate(odd)]]
    got = op2_sentencepiece(spark, tables(documents=docs)).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in docs:
        if i is not None:
            assert all(r["ids"] == library.encode(t or "") and r["n_tokens"] == len(r["ids"]) for r in by[i]), t
            assert all(r["decoded"] for r in by[i]) or "▁" in t
    assert op2_sentencepiece(spark, tables()).count() == 0


def test_decoded_is_false_for_texts_that_hold_the_space_mark(spark, tables, library):
    texts = ["a▁b", "▁", " a ▁", "a b", "▁▁x y", "", None, " two  spaces ", "漢\x01"]
    got = {r["doc_id"]: (r["decoded"], list(r["ids"])) for r in op2_sentencepiece(spark, tables(documents=[(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    assert {i: d for i, (d, _) in got.items()} == {i: "▁" not in (t or "") for i, t in enumerate(texts)}
    assert all(ids == library.encode(texts[i] or "") for i, (_, ids) in got.items())


def test_decode_gives_the_text_back(spark, edge_documents):
    pieces = Pieces.load()
    docs = spark.createDataFrame([(k, t) for k, (_, t, *_) in enumerate(edge_documents)], "k int, text string")
    back = {r["k"]: r["text"] for r in decode(encode(docs, pieces, ["k"]), pieces, ["k"]).collect()}
    assert back == {k: t or "" for k, (_, t, *_) in enumerate(edge_documents)}


def test_heap_merge_is_the_librarys(library):
    pieces = Pieces.load()
    score = {p: (s, i) for p, i, s in pieces.rows}
    rng = random.Random(9)
    for _ in range(300):
        w = "▁" + "".join(rng.choice("etaoinshrd") for _ in range(rng.randint(1, 80)))
        assert [i for _, i in merge_word(w, score)] == library.encode(w[1:])


def test_viterbi_for_unigram_models(spark):
    rng = random.Random(10)
    chars = "abc▁"
    names = sorted({"".join(rng.choice(chars[:3]) for _ in range(rng.randint(2, 4))) for _ in range(12)})
    rows = [(p, k, -rng.random() * len(p) - 0.5) for k, p in enumerate([*chars, *names, "▁a"])]
    pieces = Pieces(rows, None, 0, "viterbi")
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 25))) for _ in range(60)] + ["abc" * 40]
    got = {r["k"]: r["ids"] for r in encode(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), pieces, ["k"]).collect()}
    score = {p: (s, i) for p, i, s in rows}

    def total(ids):
        return sum(rows[i][2] for i in ids)

    for k, t in enumerate(texts):
        w = "▁" + t.replace(" ", "▁")
        assert "".join(rows[i][0] for i in got[k]) == w
        assert abs(total(got[k]) - total(best_path(w, score, pieces.longest))) < 1e-9


def test_words_are_hashed_by_their_bytes():
    of = np.zeros(0x110000, np.int32)
    of[[ord(c) for c in "abé漢😀"]] = 1
    texts = ["abé a漢b", "", None, "😀a zb"]
    joined, start, row, h = Cutter((of, np.array([[False, False], [False, True]])))(texts)
    words = [joined[a:b] for a, b in zip(start[:-1], start[1:])]
    assert words == ["▁", "abé", "▁", "a漢b", "▁", "😀a", "▁", "z", "b"] and row.tolist() == [0] * 4 + [3] * 5
    want = [run_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0] for w in words]
    assert h.tolist() == want and word_hash(words).tolist() == want


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_dictionary_of_any_hashes(n):
    rng = np.random.default_rng(n)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, np.uint64), np.arange(n // 4).astype(np.uint64), most - np.arange(n // 3).astype(np.uint64)]))
    rng.shuffle(h)
    size = rng.integers(0, 4, len(h))
    own = {int(x): [int(x) % 1000 + k for k in range(s)] for x, s in zip(h, size)}
    words = Dictionary([(h, size, np.array([i for x in h for i in own[int(x)]], np.int32))])
    asked = np.concatenate([h, [most, np.uint64(0), np.uint64(7)], rng.integers(0, 1 << 63, 5, np.uint64), h[:3]]).astype(np.uint64)
    want = [own.get(int(x), [int(x) % 7, 5]) for x in asked]
    count, ids = words(asked, lambda i: [int(asked[i]) % 7, 5])
    assert count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_characters_that_are_no_piece_alone(spark):
    """b and the space occur in longer pieces only: what no merge takes up is unknown."""
    pieces = Pieces([("a", 1, -9.0), ("ab", 2, -1.0), ("▁a", 3, -2.0)], None, 0, "merge")
    texts = ["ab", "b", "a b", "", "aab", "é"]
    got = {r["k"]: r["ids"] for r in encode(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), pieces, ["k"]).collect()}
    assert [got[k] for k in range(6)] == [[0, 2], [0, 0], [3, 0, 0], [], [3, 2], [0, 0]]
