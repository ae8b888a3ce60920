"""Queries over whole sequences and texts against plain Python."""

import duckdb
import pytest

from loomframe.operators import conversations
from loomframe.plans import catalog


@pytest.fixture
def tables(tmp_path):
    """tables(name=select, ...): a folder with these tables, made by SQL."""

    def make(**selects):
        for name, sql in selects.items():
            duckdb.sql(sql).write_parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


TALKS = """SELECT c AS conv_id, t AS turn, ['user', 'assistant'][t % 2 + 1] AS role, array_to_string([repeat('w', (i * 7 + c + t) % 9 + 1) for i in range((c * 37 + t * 11) % 150)], ' ') AS text
 FROM range(20) x(c), range(4) y(t)"""


@pytest.fixture
def talks(tables):
    """(folder, {conv_id: (ids, labels)}): conversations of up to about 500 tokens, uncut."""
    folder = tables(conversations=TALKS)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    rows = db.execute(f"WITH {catalog.TOKENS_SQL} SELECT conv_id, ids, labs FROM m").fetchall()
    assert sum(len(ids) > 64 for _, ids, _ in rows) > 15
    return folder, {c: (ids, labs) for c, ids, labs in rows}


def flat(a):
    return " ".join(map(str, a))


def test_pad_batch_pads_whole_sequences(spark, talks):
    folder, rows = talks
    longest = {b: max(len(ids) for c, (ids, _) in rows.items() if c // 8 == b) for b in range(3)}
    want = {(c, c // 8, n := longest[c // 8], flat(ids + [0] * (n - len(ids))), flat(labs + [-100] * (n - len(ids))), len(ids)) for c, (ids, labs) in rows.items()}
    got = {(r["conv_id"], r["batch_id"], r["batch_len"], r["ids"], r["labels"], r["n_attended"]) for r in catalog.pad_batch(spark, folder).collect()}
    assert got == want


def test_splice_lengths_of_whole_sequences(spark, talks):
    folder, rows = talks
    want = {}
    for c, (ids, labs) in rows.items():
        p = ids.index(-200) if -200 in ids else None
        out = labs if p is None else labs[:p] + [-100] * 32 + labs[p + 1 :]
        want[c] = (len(out), flat(out), flat(max(i, 0) for i in ids))
    assert {r["conv_id"]: (r["n_spliced"], r["labels"], r["embeddable"]) for r in catalog.splice_lengths(spark, folder).collect()} == want


def test_conversations_hold_whole_descriptions(spark, tables):
    """Line ends, trailing blanks and long texts reach the answers of all three tasks that use them."""
    text = "'  x' || d || chr(10) || repeat('a word\\t', 100 * (d % 3)) || 'end ' || d || chr(10) || '  '"
    folder = tables(
        documents=f"SELECT d AS doc_id, {text} AS text, 'en' AS lang, 's0' AS source, 1::BIGINT AS n_chars FROM range(300) x(d)",
        labels="SELECT d AS doc_id, 1::INT AS quality, 0::INT AS toxic FROM range(0, 300, 2) x(d)",
    )
    texts = {f"s0/{d}.jpg": t.strip() for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall() if d % 5 > 1}
    seen = set()
    for r in catalog.conversation_build(spark, folder).collect():
        d = int(r["image"].removeprefix("s0/").removesuffix(".jpg"))
        task = next(t for t in conversations.TASK_WEIGHTS if r["id"].endswith("_" + t))
        if r["image"] not in texts or r["from"] != "gpt" or task in ("classify", "layout") or (task == "coupled" and (r["turn"] == 1 or d % 4 == 0)):
            continue
        start = {"describe_teacher": [""], "refuse": [conversations.REFUSAL], "coupled": list(conversations.PREFIX.values())}[task]
        assert r["value"] in [s + texts[r["image"]] for s in start]
        seen.add((task, d % 3))
    assert len(seen) == 9
