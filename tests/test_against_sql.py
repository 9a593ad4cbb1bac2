"""Queries next to their SQL on small tables that the given ones don't hold: ties, tight budgets, constants."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from cohortroll.operators.stats import pearson


def both(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(str(tmp_path / f"{table}.parquet"), mode="overwrite")
        con.execute(f"create view {table} as select * from '{tmp_path / f'{table}.parquet'}/*.parquet'")
    got = entry_module.queries()[name](spark, str(tmp_path))
    cursor = con.execute(entry_module.oracle_sql()[name])
    order = [c[0] for c in cursor.description]
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    return key(got.select(*order).collect()), key(cursor.fetchall())


@pytest.fixture
def lines(spark):
    """Suppliers with 128 lines whose means lie half-way at eight digits, where engines round apart, and one with a mean at the limit."""
    rows = []
    for unit, total in enumerate((29, 57, 113, 115, 201, 203, 205, 207, 251, 253, 255, 257, 427, 431, 435, 439, 477, 481, 485, 489), 1):
        for i in range(128):
            cents = total // 128 + (i < total % 128)
            rows.append((unit * 1000 + i, i, unit, "ANR"[unit % 3], cents / 100, cents / 100))
    rows += [(70000 + i, i, 100, "A", (2, 4, 6, 7, 1)[i % 5] / 100, (2, 4, 6, 7, 1)[i % 5] / 100) for i in range(125)]
    return spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_discount double, l_tax double").repartition(7)


@pytest.mark.parametrize("name", ["ordered_association_matrix", "significant_supported_associations"])
def test_half_way_means_and_means_at_the_limit(spark, tmp_path, lines, name):
    got, want = both(spark, tmp_path, name, lineitem=lines)
    assert got == want and len(got) >= 20


@pytest.mark.parametrize("name, size", [("group_budget_allocation", 9300), ("stratified_cell_sample", 7500)])
def test_minimum_beyond_the_budget(spark, tmp_path, name, size):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3100, ("view", "click", "error")[i // 3100 % 3], start, float(i % 500), '{"k": 1}') for i in range(9300 * 4)]
    rows = [r for r in rows if (r[0] * 7919) % 11 > 2 or r[0] < 9300]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double, props string")
    got, want = both(spark, tmp_path, name, events=events)
    assert got == want and len(got) == size


def test_a_constant_side_has_no_correlation_however_it_is_merged(spark):
    df = spark.range(0, 49 * 6, 1, 6).withColumn("one", F.lit(1.0)).withColumn("x", F.col("id").cast("double"))
    row = df.agg(pearson("x", "one").alias("a"), pearson("one", "x").alias("b"), pearson("x", "x").alias("c")).first()
    assert row.a is None and row.b is None and abs(row.c - 1) < 1e-12
