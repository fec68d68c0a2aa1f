"""Every registered query against DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry
from concordat import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr) == rows


def test_entry(spark):
    rows = {r.subject: r.status for r in entry.entry(spark).collect()}
    assert set(rows) == {"mean_A", "mean_N", "mean_R", "gain", "claim_order"} and set(rows.values()) <= {"pass", "mismatch"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
