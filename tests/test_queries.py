"""Every query with SQL gives what DuckDB gives on the same tables; the others run."""

import datetime
import math

import duckdb
import pytest

from saltmarsh.plans import more_queries, small_queries  # noqa: F401
from saltmarsh.plans.queries import QUERIES, SQL

SIZES = ("sf0.001", "sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")  # the queries round to six places or fewer
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    return duckdb.connect()


@pytest.mark.parametrize("name", list(QUERIES))
@pytest.mark.parametrize("size", SIZES)
def test_query(spark, duck, name, size):
    folder = f"/root/testdata/{size}"
    df = QUERIES[name](spark, folder)
    got = df.collect()
    assert got
    if name in SQL:
        for t in TABLES:
            duck.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        rel = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(rel.columns)
        order = [rel.columns.index(c) for c in df.columns]
        want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
        have = sorted(tuple(map(plain, r)) for r in got)
        assert len(have) == len(want)
        assert [(h, w) for h, w in zip(have, want) if h != w][:3] == []
