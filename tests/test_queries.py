"""Every query against its DuckDB text on the smallest tables."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stringloom.plans import inputs
from stringloom.plans.oracles import ORACLES
from stringloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in result.fetchall())
    assert got or name == "sheet_problems"


def test_every_query_is_registered():
    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.oracle_sql().keys() >= ORACLES.keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_long_rows_are_made_by_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    """One split of a small file becomes as many tasks as its rows ask for, with the same rows."""
    parts = spark.range(1, 1001).selectExpr(
        "id as p_partkey", "concat('name ', id % 7) as p_name", "concat('brand ', id % 3) as p_brand")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    whole = sorted(inputs.view(spark, str(tmp_path), "sheet_long").collect())
    monkeypatch.setattr(inputs, "TASK_ROWS", 40)
    long = inputs.view(spark, str(tmp_path), "sheet_long")
    assert max(r["n"] for r in long.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) <= 5 * 50
    assert sorted(long.collect()) == whole and len(whole) == 5000
