"""The registered queries: each runs, and equals its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from siftlake.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.ORACLES) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["pos", "id"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    assert got
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        at = [names.index(c) for c in columns]
        want = sorted(tuple(r[i] for i in at) for r in found.fetchall())
        assert len(got) == len(want)
        for a, b in zip(sorted(map(tuple, got)), want, strict=True):
            assert a == pytest.approx(b, rel=1e-9, abs=2e-6)
