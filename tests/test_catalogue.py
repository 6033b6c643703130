"""Every query with SQL against DuckDB; every other one gives rows of a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from fathomic.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(frame):
    frame = frame[sorted(frame.columns)]
    key = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.5g}" if isinstance(v, float) else str(v)
    return list(frame.columns), sorted(tuple(key(v) for v in row) for row in frame.itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    assert plain(catalogue.QUERIES[name](spark, DATA).toPandas()) == plain(con.execute(catalogue.ORACLE_SQL[name]).df())


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
