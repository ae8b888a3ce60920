"""Token-id files, the prefix trie of conversations, fill-in-the-middle."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import token_ids, trie
from loomframe.llm.common import fresh_path, materialize
from loomframe.llm.fill_middle import UNIT, fill_in_middle, op13_fill_in_middle, places, restored
from loomframe.llm.token_ids import op11_token_ids
from loomframe.llm.trie import op12_prefix_trie

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "J̌ JJ̌ éx É", "don't DON'T 'tis rock'n'roll ('s x's", "a,b!—c —!d", "1a2 2024 1⃣", "<|startoftext|> x<|endoftext|>y <|other|> <|STARTOFTEXT|>", "tab\tnew\nline\r\n\x0bv\x0cf", " nb em　", "漢字 かな \U0001f600\U0001f600 ﬁ", "İİ ΣΣ ß", "\x00\x01\x1c", "word " * 3000, "x" * 5000, "á,b́"]


# --- token ids ---


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def encoded(texts):
    ids, bounds = token_ids.encode_texts(pa.array(texts, pa.string()), WORDS, 1)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_ids_are_the_librarys():
    assert encoded([*ODD, None]) == library([*ODD, None])
    assert encoded([]) == [] and encoded([None, ""]) == [[1], [1]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aBcJ'1.,-!<|>\n\t ̌́é— 漢İ", "<|endoftext|>", "the ", "'s"]), max_size=25).map("".join), max_size=4))
def test_pieces_are_encoded_as_in_their_text(texts):
    assert encoded(texts) == library(texts)


def test_white_space_is_no_piece():
    texts = [" a\tB  c12", "", " \n ", "x", "é 'y' "]
    raw = [t.encode() for t in texts]
    coded, bounds = token_ids._pieces(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    pieces = coded.to_pylist()
    assert [pieces[a:b] for a, b in zip(bounds[:-1], bounds[1:])] == [["a", "b", "c", "1", "2"], [], [], ["x"], ["é", "'y'"]]


def test_a_small_memory_of_pieces(monkeypatch):
    monkeypatch.setattr(token_ids, "MEMORY", 3)
    assert encoded(ODD) == library(ODD) and encoded(ODD[:3]) == library(ODD[:3])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(65_000, 66_000), max_size=40))
def test_code_round_trip(numbers):
    control, data = token_ids.pack(np.array(numbers, np.uint32))
    assert len(control) == -(-len(numbers) // 4) and len(data) == sum(max(1, (n.bit_length() + 7) // 8) for n in numbers)
    assert token_ids.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(numbers)).tolist() == numbers


def test_damage_is_seen():
    raw = token_ids.block(0, 0, [(5, np.array([1, 2, 70_000], np.uint32)), (None, np.zeros(0, np.uint32))]) + b"\0"
    ((part, first, names, counts, ranks),) = token_ids.read_blocks(memoryview(raw))
    assert (part, first, names, counts.tolist(), ranks.tolist()) == (0, 0, [5, None], [3, 0], [1, 2, 70_000])
    for at in (0, len(raw) - 3, len(raw) - 1):
        with pytest.raises(ValueError):
            list(token_ids.read_blocks(memoryview(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])))


def expected_rows(rows):
    """(doc_id, n, crc) with starts by doc_id; rows that share an id in the order of number and checksum."""
    one = sorted(((i is not None, i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, library([t for _, t in rows]))), key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
    at, out = 0, []
    for _, i, n, crc in one:
        out.append((i, at, n, crc))
        at += n
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_IDS": 50, "FILE_BLOCKS": 2, "RANGE_IDS": 400}])
def test_files_round_trip(spark, tables, edge_documents, sizes):
    rows = [(i, t) for i, t, *_ in edge_documents] + list(enumerate(ODD, 100))
    folder = tables(documents=[(i, t, None, None, None) for i, t in rows])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    if not sizes:
        got = op11_token_ids(spark, folder).collect()
    else:
        out = fresh_path(spark, "files")
        tokens = materialize(token_ids.tokenised(docs.repartition(5), WORDS), "tokens")
        token_ids.write_ids(tokens, out, token_ids.vocabulary_size(WORDS), *sizes.values())
        got = token_ids.read_ids(spark, out).collect()
        assert spark.read.format("binaryFile").load(f"{out}/ids").count() > 5
        assert sorted(map(bytes, (r["ids"] for r in got))) == sorted(np.array(x, "<u4").tobytes() for x in library([t for _, t in rows]))
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == expected_rows(rows)


def test_files_follow_the_order_of_ids(spark, tables):
    rng = random.Random(1)
    folder = tables(documents=[(i, " ".join("abcdef"[: rng.randint(1, 6)] for _ in range(30)), None, None, None) for i in rng.sample(range(10_000), 300)])
    out = fresh_path(spark, "files")
    token_ids.write_ids(materialize(token_ids.tokenised(spark.read.parquet(f"{folder}/documents.parquet"), WORDS), "tokens"), out, token_ids.vocabulary_size(WORDS), 100, 3, 1000)
    names = [i for f in sorted(spark.read.format("binaryFile").load(f"{out}/ids").select("path", "content").collect()) for b in token_ids.read_blocks(memoryview(f["content"])) for i in b[2]]
    assert names == sorted(names) and len(names) == 300


def test_no_documents_no_ids(spark, tables):
    assert op11_token_ids(spark, tables()).count() == 0


# --- the trie ---


def plain_trie(rows):
    """Nodes of the rebuilt conversations, by sets of members."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for key, of in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = lambda n: [k for k in members if len(k) == len(n) + 1 and k[: len(n)] == n]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in of if whole[c] == key)))
        out.append((min(of), len(key), min(members[key[:-1]]) if key else None, len(of), len(children(key)), sum(not children(k) for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(spark, folder):
    return sorted((tuple(r[c] for c in NODE) for r in op12_prefix_trie(spark, folder).collect()), key=repr)


@pytest.fixture
def odd_conversations():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "éé"])) for c in range(40) for t in range(rng.randint(1, 12)) if c not in (10, 25)]
    same = [(t, "user", f"t{t % 3}") for t in range(20)]
    rows += [(c, *x) for c in (*range(100, 130), 55) for x in same] + [(131, *x) for x in same[:15]] + [(132, *x) for x in [*same, (20, "user", "more")]]
    rows += [(200, None, None, None), (200, None, "user", None), (200, 1, None, "x"), (200, 1, "user", "y"), (200, 1, "user", "y"), (None, 0, "user", "lost"), (-3, 0, "user", "a"), (7_000_000_001, 0, "user", "a" * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_trie_against_sets(spark, tables, odd_conversations, small, monkeypatch):
    if small:  # many ranges, keys of two turns, lists in pieces of three
        monkeypatch.setattr(trie, "RANGE_ROWS", 60)
        monkeypatch.setattr(trie, "CHUNK", 2)
        monkeypatch.setattr(trie, "PIECE", 3)
    got = trie_rows(spark, tables(conversations=odd_conversations))
    assert got == plain_trie(odd_conversations)


def test_preorder_intervals(spark, tables, odd_conversations):
    folder = tables(conversations=odd_conversations)
    nodes = trie.prefix_trie(*trie.rebuilt(spark.read.parquet(f"{folder}/conversations.parquet"))).collect()
    assert sorted(r["start"] for r in nodes) == list(range(len(nodes)))
    for r in nodes:
        inside = [x for x in nodes if r["start"] <= x["start"] <= r["stop"]]
        assert all(x["stop"] <= r["stop"] and (x["depth"] > r["depth"] or x is r) for x in inside)
        assert sum(not x["n_children"] for x in inside) == r["n_leaves"]


def test_trie_of_little(spark, tables):
    assert trie_rows(spark, tables()) == []
    c = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # its only turn is cut off, and there is nothing to lend
    assert trie_rows(spark, tables(conversations=[(c, 0, "user", "x")])) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# --- fill in the middle ---


def plain_middle(i, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h, units = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)], re.findall(UNIT, text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middle_against_lists(spark, tables, edge_documents):
    marks = ["a <P> b", "<M>", "x<S>", "<<S <P< M>", "<p> <s> <m>", "P>a<", "ends with <S"] * 8
    rows = [(i, t) for i, t, *_ in edge_documents] + list(enumerate([*ODD, *marks], 100)) + [(-5, "minus " * 4), (2**62, "far")]
    folder = tables(documents=[(i, t, None, None, None) for i, t in rows])
    want = sorted(((i, *plain_middle(i, t)) for i, t in rows), key=repr)
    out = fill_in_middle(spark.read.parquet(f"{folder}/documents.parquet"))
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = out.select("doc_id", restored(out["output"], out["form"]).alias("text")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    digests = sorted(((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in op13_fill_in_middle(spark, folder).collect()), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert digests == sorted(((i, sha(plain_middle(i, t)[-1]), sha(t or "")) for i, t in rows), key=repr)
    assert op13_fill_in_middle(spark, tables()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab Z.é\n<P>"), max_size=30), st.data())
def test_places_of_ranks(text, data):
    units = re.findall(UNIT, text)
    low = data.draw(st.integers(0, len(units)))
    high = data.draw(st.integers(low, len(units)))
    assert places(re.compile(UNIT), text, low, high) == (len("".join(units[:low])), len("".join(units[:high])))


def test_forms_are_dealt_as_asked(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'some text of words' AS text")
    share = {r["form"]: r["count"] / 2000 for r in fill_in_middle(docs, plain=50, spm=50).groupBy("form").count().collect()}
    assert all(abs(share[f] - x) < 0.05 for f, x in (("plain", 0.5), ("psm", 0.25), ("spm", 0.25)))
