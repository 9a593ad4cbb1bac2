"""Model fits send sums, not rows: results next to direct ones, and what their plans exchange."""

import numpy as np
import pandas as pd
import pytest

from cohortroll import session
from cohortroll.operators import expression as ex
from cohortroll.operators import glm
from cohortroll.operators import mixed_models as mm
from cohortroll.operators.glm import fit_grouped


def test_rows_that_are_their_own_cluster_are_summed_in_place(spark):
    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"t": np.arange(n) % 2, "id": np.arange(n), "x0": 1.0, "a": (np.arange(n) % 3 == 0) * 1.0, "x": rng.normal(size=n)})
    pdf["o"] = rng.normal(size=n) * 0.1
    pdf["y"] = rng.poisson(np.exp(0.3 + 0.4 * pdf.a + 0.5 * pdf.x + pdf.o)).astype(float)
    rows = spark.createDataFrame(pdf)
    args = dict(family="poisson", offset="o", groups=[[1]])
    one, many = ([r.asDict() for r in fit_grouped(rows, ["t"], "y", ["x0", "a", "x"], ["id"], single=s, **args).orderBy("t").collect()] for s in (True, False))
    for got, want in zip(one, many):
        assert got.keys() == want.keys() and got["status"] == want["status"] == "completed"
        for name, value in want.items():
            assert got[name] == (pytest.approx(value, rel=1e-8, abs=1e-12) if isinstance(value, (float, list)) else value), name
    # A row without an outcome ends its test's fit as it does by cluster, and no other.
    holed = spark.createDataFrame(pdf.assign(y=pdf.y.where(pdf.id != 2).astype(object).where(lambda v: v.notna(), None)), "t long, id long, x0 double, a double, x double, o double, y double")
    state = {r.t: r.status for r in fit_grouped(holed, ["t"], "y", ["x0", "a", "x"], ["id"], single=True, **args).collect()}
    assert state[1] == "completed" and state[0] != "completed"


def test_grid_of_counts_unfolds_after_the_shuffle(spark):
    profiles = spark.createDataFrame([("a|P", "P", 1.5), ("b|P", "P", 2.5), ("c|Q", "Q", 3.5), ("d|R", "R", 4.5)], "profile_id string, cell_type string, age double")
    genes = spark.createDataFrame([("P", 1), ("P", 2), ("P", 3), ("Q", 2)], "cell_type string, gene_id long")
    sums = spark.createDataFrame([("a|P", 1, 5), ("a|P", 9, 7), ("b|P", 3, None), ("c|Q", 1, 4), ("d|R", 1, 4)], "profile_id string, gene_id long, count long")
    grid = ex.dense_counts(profiles, sums, genes)
    got = sorted((r.profile_id, r.gene_id, r["count"], r.age) for r in grid.collect())
    assert got == [("a|P", 1, 5, 1.5), ("a|P", 2, 0, 1.5), ("a|P", 3, 0, 1.5), ("b|P", 1, 0, 2.5), ("b|P", 2, 0, 2.5), ("b|P", 3, 0, 2.5), ("c|Q", 2, 0, 3.5)]
    plan = grid._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = [line for line in plan[:next(k for k, line in enumerate(plan) if "Generate inline" in line)] if "Join" in line]
    assert above == []


def test_weights_read_their_curve_without_carrying_it(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"cell_type": ["P", "Q"] * 40, "gene_id": np.arange(80) // 10, "x0": 1.0, "log_cpm": rng.normal(5, 1, 80), "log_size": 21.0})
    lines = ex.gene_lines(spark.createDataFrame(pdf), ["x0"], "log_cpm")
    trend = spark.createDataFrame([("P", [1.0, 6.0], [0.5, 1.5]), ("Q", [1.0, 3.0, 9.0], [0.5, 0.7, 2.0])], "cell_type string, knots array<double>, levels array<double>")
    out = ex.precision_weights(spark.createDataFrame(pdf), lines, trend, ["x0"])
    assert "knots" not in out._jdf.queryExecution().optimizedPlan().toString()
    fitted = pdf.groupby(["cell_type", "gene_id"]).log_cpm.transform("mean") + 21.0 - np.log2(1e6)
    curve = {r.cell_type: (r.knots, r.levels) for r in trend.collect()}
    want = sorted(np.interp(v, *curve[t]) ** -4 for v, t in zip(fitted, pdf.cell_type))
    assert sorted(r.weight for r in out.collect()) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("family", ["gaussian", "binomial"])
def test_clusters_are_summed_in_tasks_of_bounded_size(spark, monkeypatch, family):
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"t": np.arange(n) % 2, "id": np.arange(n) // 3, "x0": 1.0, "a": (np.arange(n) % 3 == 0) * 1.0, "x": rng.normal(size=n)})
    eta = 0.3 * pdf.x - 0.2 * pdf.a + rng.normal(size=n // 3)[pdf.id]
    pdf["y"] = eta + rng.normal(size=n) if family == "gaussian" else (rng.random(n) < 1 / (1 + np.exp(-eta))) * 1.0
    seen = []
    plain = glm._cluster_sums
    monkeypatch.setattr(glm, "_cluster_sums", lambda *args: seen.append(plain(*args)) or seen[-1])

    def fitted():
        return [r.asDict() for r in fit_grouped(spark.createDataFrame(pdf), ["t"], "y", ["x0", "a", "x"], ["id"], family=family, exchangeable=True, groups=[[1]]).orderBy("t").collect()]

    want = fitted()
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    seen.clear()
    for got, known in zip(fitted(), want):
        assert got["status"] == known["status"] == "completed"
        for name, value in known.items():
            assert got[name] == (pytest.approx(value, rel=1e-7, abs=1e-10) if isinstance(value, (float, list)) else value), name
    assert seen and all(sums.rdd.getNumPartitions() == n // 50 for sums in seen[:1])
    assert all("Exchange hashpartitioning(id" in s._jdf.queryExecution().executedPlan().toString() and "Exchange hashpartitioning(t" not in s._jdf.queryExecution().executedPlan().toString() for s in seen)


def test_subject_sums_are_written_once_and_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n = 240
    pdf = pd.DataFrame({"cell_type": "P", "gene_id": np.arange(n) % 4, "subject_id": [f"s{k // 8}" for k in range(n)], "x0": 1.0,
                        "a": rng.normal(size=n), "v": rng.normal(size=n), "w": rng.uniform(0.5, 2, size=n)})
    weighted = spark.createDataFrame(pdf)
    flat = lambda df: {(r.gene_id, r.subject_id): [r.n, r.w, *r.xx, *r.xs, *r.xy, r.y, r.yy, r.mw] for r in df.collect()}
    want = flat(mm.subject_sums(weighted, ["x0", "a"], "v", "w"))
    written = []
    plain = mm.keep
    monkeypatch.setattr(mm, "keep", lambda df, label: written.append((label, df)) or plain(df, label))
    monkeypatch.setattr(session, "TASK_ROWS", 40)
    got = flat(mm.subject_sums(weighted, ["x0", "a"], "v", "w"))
    assert got.keys() == want.keys() and len(got) == 120
    for key, values in want.items():
        assert got[key] == pytest.approx(values, rel=1e-12)
    assert [label for label, _ in written] == ["subjects", "mean-weights"]
    plan = written[0][1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(subject_id" in plan
    per = pdf.assign(o=1).groupby(["gene_id"]).w.mean()
    assert {k[0]: pytest.approx(v[-1], rel=1e-12) for k, v in got.items()} == dict(per)
