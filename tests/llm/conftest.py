import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Columns that no operator asks for, with names that operators use inside.
CLASHING = ["row", "block", "k1", "n", "h", "score", "label", "ids", "hash", "node", "spans", "size", "b", "held_out"]

SCHEMAS = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]),
    "labels": pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
    "conversations": pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]),
    "embeddings": pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]),
}


@pytest.fixture
def tables(tmp_path):
    """tables(documents=[(...), ...], ...): a folder with these tables; the others are empty. Each has the clashing columns."""

    def make(**rows):
        for name, schema in SCHEMAS.items():
            data = list(zip(*rows.get(name, []))) or [[] for _ in schema]
            t = pa.table([pa.array(c, f.type) for c, f in zip(data, schema)], schema=schema)
            for c in CLASHING:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array(["x"] * t.num_rows, pa.string()))
            pq.write_table(t, tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return make


def prose(rng, n, bank=None):
    bank = bank or ["alpha", "beta", "Gamma", "delta,", "épsilon", "zeta.", "eta", "théta", "iota", "kappa"]
    return " ".join(rng.choice(bank) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture
def edge_documents():
    """Nulls, empty and very long texts, copies, near copies with edits, shared passages, runs of one letter, many scripts."""
    rng = random.Random(3)
    base = prose(rng, 300)
    words = base.split(" ")
    shared = prose(rng, 90)
    rows = [
        (0, base), (1, base), (2, " ".join(words[:150] + ["EDIT"] + words[151:])), (3, " ".join(words[:40] + ["x", "y"] + words[42:])), (4, None), (5, ""), (6, "   \n\t"), (7, "one"), (8, "One"), (9, "two words"),
        (10, "a" * 2000), (11, "Orre " * 400), (12, prose(rng, 20) + " " + shared + " " + prose(rng, 30)), (13, prose(rng, 5) + " " + shared), (14, shared + prose(rng, 50)), (15, "漢字 かな 😀 ﬁ é́   tab\tend"), (16, prose(rng, 12_000)),
        (17, "\x01\x02 <s> </s> <0x41> <unk>"), (18, "12 34 56"), (19, "bcd" * 300 + shared[:399]), (None, base), (None, None), (20, base), (20, base), (21, "é" * 700), (22, "  leading and  double  spaces "),
    ]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t)) for i, t in rows]
