"""Every query against its SQL in DuckDB."""

import glob

import duckdb
import pandas as pd
import pytest
from stratalog.oracle import oracle_sql
from stratalog.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {path.split('/')[-1].split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if pd.isna(x) else x if isinstance(x, str) else float(x) if isinstance(x, float) else int(x)
    return sorted(str([plain(x) for x in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf, con, name):
    mine, want = QUERIES[name](spark, sf).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert rows(mine) == rows(want)


def test_all_have_sql():
    assert set(QUERIES) == set(oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(QUERIES) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_small(spark, sf, name):
    """No step of a token is copied into the next when filters travel to the scan, no rows
    are compared all with all, and no one task orders keys or cells."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution()
    assert len(plan.optimizedPlan().toString()) < 200_000
    physical = plan.executedPlan().toString()
    single_rows = {"engine_stats", "read_amplification", "write_amplification", "strategy_comparison", "tier_share", "log_metrics"}
    if name not in single_rows:
        assert "CartesianProduct" not in physical and "NestedLoopJoin" not in physical
