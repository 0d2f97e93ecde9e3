"""Registered queries run, and those with SQL agree with it."""

import duckdb
import pytest

import __spark_entry__ as entry
from larkspur.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    if name not in entry.oracle_sql():
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = ({tuple(map(str, r)) for r in x[columns].itertuples(index=False)} for x in (got, want))
    assert a == b and len(got) == len(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
