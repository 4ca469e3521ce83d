"""Every query with SQL against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else f"{v:.9g}")
    if isinstance(v, int):
        return (1, f"{float(v):.9g}" if abs(v) < 10**9 else str(v))
    return (1, str(v))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rel = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()])
    want = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()])
    assert len(got) == len(want)
    assert got == want


def test_every_query_is_listed():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 25
