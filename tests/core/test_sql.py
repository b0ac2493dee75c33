"""Every registered query against its SQL in DuckDB at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from vellumspark import queries as _registered  # noqa: F401
from vellumspark import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(df):
    def value(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        if hasattr(v, "item") and not hasattr(v, "isoformat"):
            v = v.item()
        return str(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(value(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
