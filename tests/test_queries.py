"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

from barwright.queries import QUERIES, SQL

DATA = Path(os.environ.get("BARWRIGHT_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def _cell(v):
    return ("f", round(v, 5) + 0.0) if isinstance(v, float) and math.isfinite(v) else ("x", str(v))


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(_cell(x) for x in r) for r in df.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(_cell(x) for x in r) for r in duck.execute(f"select {quoted} from ({SQL[name]})").fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_the_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
