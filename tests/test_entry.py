from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from minewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows, columns):
    cell = lambda x: (x is None or isinstance(x, float) and math.isnan(x), round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x))
    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert plain(rows, sorted(names)) == plain(want, sorted(names))


def test_contract(spark):
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.entry(spark).columns == ["user_id", "rank", "item_id", "title", "predicted_rating"]
