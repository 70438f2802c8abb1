"""Every query that has SQL gives what DuckDB gives on the small tables."""

import duckdb
import pandas as pd
import pytest

from quillspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(frame):
    def one(v):
        if pd.isna(v):
            return "-"
        if isinstance(v, str | bool):
            return str(v)
        try:
            return str(int(v)) if float(v) == int(v) else repr(round(float(v), 5))
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain(got.astype(object)) == _plain(want.astype(object))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
