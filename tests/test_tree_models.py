"""Grouped tree fits: exact splits, leaks, sampling bound, and the nested choice."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortroll.operators import predict as pr
from cohortroll.operators import tree_models as tm

SMALL = (tm.Boosting("a", n_trees=30, depth=2, rate=0.3, min_rows=3), tm.Boosting("b", n_trees=20, depth=3, rate=0.3, penalty=1.0, rows=0.8, columns=0.8, min_rows=1, min_weight=1.0))


def plain_best_split(x, g, w, penalty, min_rows):
    """Best single cut over all features and values, by trying each."""
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < min_rows:
                continue
            gain = sum(g[s].sum() ** 2 / (w[s].sum() + penalty) for s in (left, ~left)) - g.sum() ** 2 / (w.sum() + penalty)
            if gain > best[0] + 1e-12:
                best = (gain, f, cut)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_first_tree_is_split_by_split_the_best_one(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(60, 4)).astype(np.float32)
    y, w = x[:, 1] * 2 - (x[:, 2] > 5) * 7 + rng.normal(size=60), rng.uniform(0.5, 2, 60)
    base, feature, threshold, value = tm.fit_trees(x, y, w, tm.Boosting("t", n_trees=1, depth=2, rate=1.0, penalty=0.7, min_rows=4), (1, 2))
    assert base == pytest.approx((w * y).sum() / w.sum())
    g = (y - base) * w
    _, f, cut = plain_best_split(x, g, w, 0.7, 4)
    assert (feature[0, 0], threshold[0, 0]) == (f, cut)
    for side, k in ((x[:, f] <= cut, 1), (x[:, f] > cut, 2)):
        gain, f2, cut2 = plain_best_split(x[side], g[side], w[side], 0.7, 4)
        assert (feature[0, k], threshold[0, k]) == ((f2, cut2) if f2 is not None else (0, np.inf))
        low = side & (x[:, feature[0, k]] <= threshold[0, k])
        assert value[0, 2 * (k - 1)] == pytest.approx(g[low].sum() / (w[low].sum() + 0.7))
    assert tm.walk(x, base, feature, threshold, value).shape == (60,)


def test_boosting_learns_and_its_walk_follows_each_row():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = 40 + 10 * (x[:, 0] > 0) * (x[:, 1] > 0) + rng.normal(size=400)
    for settings in tm.FAMILIES:
        base, feature, threshold, value = tm.fit_trees(x, y, np.ones(400), settings, (1, 2))
        got = tm.walk(x, base, feature, threshold, value)
        assert ((got - y) ** 2).mean() < 0.2 * y.var() and feature.shape == (settings.n_trees, 2**settings.depth - 1)
        for row in range(5):
            total = base
            for f, c, v in zip(feature, threshold, value):
                node = 0
                while node < len(f):
                    node = 2 * node + 1 + int(x[row, f[node]] > c[node])
                total += v[node - len(f)]
            assert got[row] == pytest.approx(total, abs=1e-9)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    out = []
    for s in range(40):
        age = 20.0 + s % 37
        for kind in ("x", "y"):
            vec = [float(v) for v in rng.normal(size=4)]
            vec[0] = float((age > 40) * 3 + rng.normal() * 0.3)
            out.append((f"S{s}", f"S{s}-{kind == 'y' and s % 3 == 0}", kind, age, 5 + s % 4, vec))
    return spark.createDataFrame(out, "subject_id string, sample_unit_id string, cell_type string, age double, n_cells bigint, vec array<double>")


def test_nested_predictions_hold_out_their_subjects(spark, rows):
    preds, choices = tm.nested_models(rows, "subject_id", 4, 3, (1.0, 100.0), SMALL, seed=3)
    preds = preds.toPandas()
    names = {"ridge_alpha_1.0", "ridge_alpha_100.0", "a", "b", "nested_best"}
    assert set(preds.model) == names and (preds.groupby("model").size() == 80).all()
    chosen = {r.fit_outer: r for r in choices.collect()}
    assert set(chosen) == {0, 1, 2, 3} and all(r.model in names for r in chosen.values())
    key = ["subject_id", "cell_type"]
    for fold, r in chosen.items():  # the nested model is the chosen candidate of each fold
        a = preds[(preds.model == "nested_best") & (preds.outer_fold == fold)].set_index(key).age_pred.sort_index()
        b = preds[(preds.model == r.model) & (preds.outer_fold == fold)].set_index(key).age_pred.sort_index()
        assert np.allclose(a, b)
    # Refitting without the outer fold by hand gives the same, so no held-out subject was seen.
    folded = pr.with_folds(rows, "subject_id", 4, 3).withColumn("h", F.xxhash64("subject_id", "sample_unit_id", "cell_type")).toPandas()
    assert (folded.groupby("subject_id").outer_fold.nunique() == 1).all()
    for fold in (0, 3):
        train = folded[folded.outer_fold != fold].sort_values(["h", "sample_unit_id", "cell_type"])
        test = folded[folded.outer_fold == fold]
        w = 1 / train.subject_rows.to_numpy(float)
        fit = tm.fit_trees(tm.design(train, ["x", "y"], 4), train.age.to_numpy(), w / w.mean(), SMALL[1], (3, (fold + 1) * 10_000))
        want = np.clip(tm.walk(tm.design(test, ["x", "y"], 4), *fit), train.age.min(), train.age.max())
        got = preds[(preds.model == "b") & (preds.outer_fold == fold)].set_index(key).age_pred
        assert np.allclose(got.loc[list(map(tuple, test[key].to_numpy()))].to_numpy(), want)


def test_inner_choice_is_the_least_error_of_inner_folds(spark):
    rows = [(0, m, "S1", u, a, p, n) for m, u, a, p, n in (
        ("late", "u1", 30.0, 31.0, 1), ("late", "u1", 30.0, 35.0, 3), ("late", "u2", 40.0, 40.0, 2),
        ("early", "u1", 30.0, 34.0, 4), ("early", "u2", 40.0, 40.0, 2), ("worse", "u1", 30.0, 50.0, 1), ("none", "u1", 30.0, None, 1))]
    df = spark.createDataFrame(rows, "fit_outer int, model string, subject_id string, sample_unit_id string, age double, age_pred double, n_cells bigint")
    best = tm.choose_candidates(df, ["worse", "early", "late", "none"]).collect()
    assert [(r.fit_outer, r.model, r.mae) for r in best] == [(0, "early", 2.0)]  # late has the same error
    assert tm.choose_candidates(df, ["late", "early"]).first().model == "late"


def test_a_fit_sees_no_more_rows_than_allowed(spark, rows):
    folded = pr.with_folds(rows, "subject_id", 2, 1).cache()
    few = tm.tree_fits(folded, SMALL[:1], ["x", "y"], 4, 2, 0, 3, most=10)
    again = tm.tree_fits(folded.repartition(5), SMALL[:1], ["x", "y"], 4, 2, 0, 3, most=10)
    assert set(few) == {(0, -1, "a"), (1, -1, "a")} and all(np.array_equal(few[k][2], again[k][2]) for k in few)
    pdf = folded.withColumn("h", F.xxhash64("subject_id", "sample_unit_id", "cell_type")).where("outer_fold <> 0").toPandas().sort_values("h").head(10)
    assert isinstance(pdf, pd.DataFrame) and (few[0, -1, "a"][4], few[0, -1, "a"][5]) == (pdf.age.min(), pdf.age.max())
