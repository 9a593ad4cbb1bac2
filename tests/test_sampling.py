"""Seeded samples against a full sort of the draw keys."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortroll.operators import sampling as sp


def smallest(rows, n, seed):
    return set(sorted(rows, key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())[:n])


@pytest.mark.parametrize("edge", [1, 7, 200_000])
def test_any_edge_size_gives_the_smallest_keys(spark, monkeypatch, edge):
    monkeypatch.setattr(sp, "EDGE", edge)
    df = spark.range(3000).withColumn("take", F.lit("a clashing column")).repartition(5)
    for n in (0, 1, 750, 2999, 3000, 9000):
        got = [r.id for r in sp.seeded_take(df.drop("take"), ["id"], n, 4, digits=1).collect()]
        assert len(got) == min(n, 3000) and set(got) == smallest(range(3000), n, 4)


def test_groups_have_their_own_edges(spark, monkeypatch):
    monkeypatch.setattr(sp, "EDGE", 3)
    df = spark.range(2000).withColumn("g", F.when(F.col("id") < 1500, "hot").when(F.col("id") < 1990, "mid").when(F.col("id") < 1998, "few").otherwise("none"))
    take = spark.createDataFrame([("hot", 301), ("mid", 490), ("few", 100), ("none", 0)], "g string, take int")
    got = sp.seeded_take(df, ["id"], take, 9, ["g"], digits=1).collect()
    by = lambda g: {r.id for r in got if r.g == g}
    assert by("hot") == smallest(range(1500), 301, 9) and by("mid") == set(range(1500, 1990)) and by("few") == set(range(1990, 1998)) and not by("none")
    assert len(got) == 301 + 490 + 8


def test_equal_ids_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(sp, "EDGE", 2)
    df = spark.range(30).select((F.col("id") % 3).alias("id"))
    assert sp.seeded_take(df, ["id"], 14, 1).count() == 14
    assert sp.seeded_take(df.limit(0), ["id"], 14, 1).count() == 0
