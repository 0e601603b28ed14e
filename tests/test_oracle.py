"""Every registered query against its DuckDB oracle on the smallest driver tables (the driver's check, in small)."""

import duckdb
import pytest

import __spark_entry__ as entry
from newsloom.plans.fixtures import TABLES
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
SQLS = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_entry_and_sql_is_subset():
    assert set(SQLS) <= set(QUERIES)
    assert len(QUERIES) >= 100


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan  # no cross joins
    got = df.toPandas()
    want = con.execute(SQLS[name]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["cluster", "rank", "doc_id"]
