"""Each registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loomframe.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
    cur = db.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
