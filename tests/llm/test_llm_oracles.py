"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from lociq.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(repr, got[cols].astype(object).values.tolist())) == sorted(map(repr, want[cols].astype(object).values.tolist()))


def test_all_ten_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))
