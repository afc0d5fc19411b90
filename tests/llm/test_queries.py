"""Every query of the subpackage against its SQL on the smallest test data."""

import os
from pathlib import Path

import pytest

from tools.compare import digest
from vaultframe.llm import queries as catalogue

DATA = Path(os.environ.get("VAULTFRAME_TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    rows = [tuple(r) for r in df.collect()]
    if name in catalogue.SQL:
        cur = con.execute(catalogue.SQL[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert digest(df.columns, rows)[:2] == digest(cols, cur.fetchall())[:2]


def test_names():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
