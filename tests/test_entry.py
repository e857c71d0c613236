"""Named queries against their SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quirewise.plans import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def values(df):
    return sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.to_dict("records"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query(spark, con, name):
    got, want = core.QUERIES[name](spark, DATA).toPandas(), con.sql(core.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA) or entry.llm is None, reason="no test tables or no subpackage")
@pytest.mark.parametrize("name", sorted(entry.llm.ORACLE) if entry.llm else [])
def test_llm_query(spark, con, name):
    got, want = entry.llm.QUERIES[name](spark, DATA).toPandas(), con.sql(entry.llm.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and values(got) == values(want)
