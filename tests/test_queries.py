"""Every query with SQL gives what the SQL gives in another engine."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from veilscan.plans.queries import REGISTRY

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(df):
    def one(x):
        x = x.item() if hasattr(x, "item") else x
        if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
            return "null"
        return f"{x:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(df.columns), sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_against_sql(spark, con, name):
    f, sql = REGISTRY[name]
    assert plain(f(spark, str(TABLES)).toPandas()) == plain(con.sql(sql).df())


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if not sql])
def test_runs(spark, name):
    """Without SQL: it gives rows, and the same ones again from rows in other partitions and order."""
    tables = str(TABLES.with_name("sf0.01"))
    first = plain(REGISTRY[name][0](spark, tables).toPandas())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert first[1] and plain(REGISTRY[name][0](spark, tables).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
