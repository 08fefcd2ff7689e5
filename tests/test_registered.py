"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, compare


@pytest.fixture(scope="module")
def con(small):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, small, name):
    verdict, _ = compare(spark, con, name, small)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 50
