"""Each registered query outside the llm folder against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from tallyforge.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = oracle.sql(registry.SQL[name])
    names = result.columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in result.fetchall()), key=repr)
    assert columns == sorted(names)
    assert got == want


def test_every_query_has_a_name_of_its_own():
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(5).count() >= 0


@pytest.mark.parametrize("name", ["q02_match_cascade", "q09_prefix_longest_match", "q09b_prefix_tiers", "q44_bm25_topk", "q47_quote_verify"])
def test_no_nested_loop(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
