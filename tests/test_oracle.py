"""Every registered query runs, and equals its SQL in DuckDB where there is one."""

import math
from decimal import Decimal

import duckdb
import pytest

from siftlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, Decimal)) or hasattr(v, "dtype"):
        return "None" if math.isnan(float(v)) else f"{round(float(v), 6) + 0.0:.6f}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, want.fetchall())
