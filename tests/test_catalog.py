"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from tracemill import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = catalog.queries()[name](spark, DATA)
    wanted = db.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in wanted.fetchall())


def test_entry_imports_without_the_training_data_part():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
