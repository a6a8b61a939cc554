import os
from pathlib import Path

import duckdb
import pytest

from sievemark.llm import queries

DATA = Path(os.environ.get("TESTDATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.execute(f"create view {t.stem} as select * from '{t}'")
    got = queries.QUERIES[name](spark, str(DATA))
    con.execute(queries.SQL[name])
    columns = [c[0] for c in con.description]
    order = lambda rows, names: sorted(tuple(f"{r[names.index(c)]:.6g}" if isinstance(r[names.index(c)], float) else str(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert order(got.collect(), got.columns) == order(con.fetchall(), columns)


@pytest.mark.parametrize("name", [k for k in queries.QUERIES if k not in queries.SQL])
def test_query_runs(spark, name):
    got = queries.QUERIES[name](spark, str(DATA))
    assert len(set(got.columns)) == len(got.columns) and got.count() >= 0
