"""Bootstrap draws: whole replicates across leaves, the same by tasks, columns and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortroll.operators import resampling as rs
from cohortroll.operators import sampling as sp


def test_mixing_is_the_same_in_columns(spark):
    values = [0, 1, 2, 65535, 65536, 2**31, 2**32 - 1, 123456789, 3735928559]
    got = spark.createDataFrame([(v,) for v in values], "h bigint").select(rs.mix32_column(F.col("h")).alias("m")).collect()
    assert [r.m for r in got] == rs.mix32(np.array(values, np.uint64)).tolist()
    assert len(set(rs.mix32(np.arange(100_000, dtype=np.uint64)).tolist())) == 100_000  # a permutation


@pytest.mark.parametrize("n", [1, 7, 10, 11, 95, 1000])
def test_leaves_hold_all_draws_and_each_row_is_as_likely(n, monkeypatch):
    monkeypatch.setattr(rs, "LEAF", 10)
    leaves = -(-n // 10)
    weights = np.zeros((400, n), int)
    for leaf in range(leaves):
        for b, w in rs.leaf_weights(77, n, leaf, 400):
            weights[b - 1, leaf * 10:leaf * 10 + len(w)] = w
    assert (weights.sum(1) == n).all()
    mean = weights.mean(0)
    assert np.abs(mean - 1).max() < 6 * np.sqrt((1 - 1 / n) / 400) + 1e-9
    if n > 20:  # the variance of a multinomial count, and the correlation of two of them
        assert abs(weights.var(0).mean() - (1 - 1 / n)) < 0.1
        assert abs(np.corrcoef(weights[:, 0], weights[:, n - 1])[0, 1] + 1 / n) < 0.2


def test_sums_over_many_leaves_are_those_of_the_weights(spark, monkeypatch):
    monkeypatch.setattr(rs, "LEAF", 16)
    rows = [(g, i, float(i * i % 13), 1.0) for g, n in (("a", 50), ("b", 9)) for i in range(n)]
    df = sp.numbered(spark.createDataFrame(rows, "g string, id int, v double, one double"), ["g"], "id")
    got = {(r.g, r["__b"]): (r.v, r.one) for r in rs.replicate_sums(df, ["g"], ["v", "one"], 30, 5).collect()}
    table = {(r.g, r["__i"]): r.v for r in df.collect()}
    base = {r.g: r.b for r in df.groupBy("g").agg(F.first(rs.test_base(5, ["g"])).alias("b")).collect()}
    for g, n in (("a", 50), ("b", 9)):
        want = np.zeros((30, 2))
        for leaf in range(-(-n // 16)):
            for b, w in rs.leaf_weights(base[g], n, leaf, 30):
                want[b - 1] += [sum(k * table[g, leaf * 16 + i] for i, k in enumerate(w)), w.sum()]
        assert all(np.allclose(got[g, b], want[b - 1]) and got[g, b][1] == n for b in range(1, 31))


def test_trends_of_small_and_large_tests_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(rng.integers(0, 6)), float(rng.integers(0, 9))) for g in "xy" for i in range(40)]
    rows += [("flat", i, 1.0, float(i)) for i in range(6)] + [("few", i, float(i), float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double")
    numbered = sp.numbered(df, ["g"], "id").where("__n >= 4").cache()
    sort = lambda frame: sorted((r.g, round(r.slope, 9), round(r.rho, 9)) for r in frame.collect())
    in_task, shuffled = rs.replicate_trends(numbered, ["g"], "x", "y", 25, 3), sp.shuffled_trends(numbered, ["g"], "x", "y", 25, 3)
    assert sort(in_task) == sort(shuffled) and len(sort(in_task)) == 50
    out = {r.g: r for r in sp.row_bootstrap(df, ["g"], "id", "x", "y", 200, 0.9, 3).collect()}
    assert set(out) == {"x", "y"} and all(r.slope_per_year_ci_low < r.slope_per_year_ci_high and r.n_good == 200 for r in out.values())


def test_interval_of_a_mean_covers_it(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(3, 2, 120)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(500, None)], "id int, v double")
    r = sp.mean_bootstrap(df, [], "id", "v", 2000, 0.95, 1).first()
    half = 1.96 * values.std() / np.sqrt(120)
    assert abs(r.mean_ci_low - (values.mean() - half)) < 0.12 and abs(r.mean_ci_high - (values.mean() + half)) < 0.12
    assert r.share_above_zero == 1.0


def test_weights_of_pairs_are_the_hits_of_all_rows(monkeypatch):
    monkeypatch.setattr(rs, "LEAF", 100)
    rng = np.random.default_rng(4)
    test = rs.RankedTest(rng.integers(0, 5, 730).astype(float), rng.integers(0, 4, 730).astype(float))
    for b in (1, 2, 77):
        rows = np.bincount(rs.hits(991, b, 730, 730), minlength=730)
        assert (np.bincount(test.pair_of_row, weights=rows) == test.weights(991, b)).all() and test.weights(991, b).sum() == 730


def test_replicates_of_a_test_beyond_a_leaf_stay_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(rs, "LEAF", 16)
    monkeypatch.setattr(rs, "SMALL", 8)
    rng = np.random.default_rng(5)
    rows = [(g, i, float(rng.normal()), float(rng.integers(0, 7))) for g, n in (("a", 90), ("b", 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double")
    numbered = sp.numbered(df, ["g"], "id").cache()
    want = sorted((r.g, round(r.slope, 9), round(r.rho, 9)) for r in sp.shuffled_trends(numbered, ["g"], "x", "y", 20, 3).collect())
    got = sorted((r.g, round(r.slope, 9), round(r.rho, 9)) for r in rs.replicate_trends(numbered, ["g"], "x", "y", 20, 3).collect())
    assert got == want and len(got) == 40

    def fail(*_):
        raise AssertionError("weights were shuffled")

    monkeypatch.setattr(sp, "shuffled_trends", fail)
    assert sp.row_bootstrap(df, ["g"], "id", "x", "y", 20, 0.9, 3).count() == 2
