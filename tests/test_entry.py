import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TESTDATA", "/root/testdata/sf0.001"))
here = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return None if v is None or isinstance(v, float) and math.isnan(v) else f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@here
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@here
@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if not k.startswith(("p3", "p4", "p6", "p7", "p8"))])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.execute(f"create view {t.stem} as select * from '{t}'")
    got = entry.queries()[name](spark, str(DATA))
    con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, con.fetchall())
