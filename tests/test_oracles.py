"""Every engine query against its SQL in DuckDB."""

import duckdb
import pytest

from lociq.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(con.execute(catalog.oracle_sql()[name]).fetchdf())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
