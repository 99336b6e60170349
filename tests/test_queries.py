"""Every registered query with a SQL twin gives the twin's rows on the smallest tables."""

import math

import duckdb
import pytest

from parcela.plans import registry
from parcela.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    return "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    twin = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(twin.columns) == columns
    theirs = sorted(tuple(map(shown, r)) for r in twin.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert ours == theirs


def test_every_query_without_a_twin_runs(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)):
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
