import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortroll.operators import expression as ex
from cohortroll.operators import predict as pr
from cohortroll.operators.association import independent_glm, subject_gee
from cohortroll.operators.glm import design_diagnostics, indicator_columns, residualise
from cohortroll.operators.represent import exact_neighbours
from cohortroll.operators.review import STRICT, candidate_evidence, review_queue, screen_status
from cohortroll.operators.sampling import cluster_bootstrap, grouped_folds, seeded_take
from cohortroll.operators.stats import age_terms


def gee_frame(kind):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(20):
        shift = rng.normal(0, 0.3)
        for v in range(1 + s % 3):
            age = 30 + 2 * s + 3 * v + 0.0
            lin = -2 + 0.03 * age + shift + rng.normal(0, 0.3)
            y = 1 / (1 + math.exp(-lin)) if kind == "binomial" else lin
            rows.append(("T", f"S{s}", f"S{s}-{v}", age, y, 50 + s))
    return pd.DataFrame(rows, columns=["cell_type", "subject_id", "sample_unit_id", "age", "y", "total"])


def numpy_gee(df, family, weights=None):
    """Plain exchangeable GEE with per-cluster matrices, as the yardstick."""
    x = np.column_stack([np.ones(len(df)), (df.age - df.age.mean()) / 10])
    y, groups = df.y.to_numpy(), [np.flatnonzero(df.subject_id == s) for s in df.subject_id.unique()]
    f = {i: 1.0 if weights is None else float(weights[g[0]]) for i, g in enumerate(groups)}
    beta, alpha = np.zeros(2), 0.0
    for _ in range(200):
        eta = x @ beta
        mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else eta
        d = mu * (1 - mu) if family == "binomial" else np.ones_like(mu)
        r = (y - mu) / np.sqrt(d)
        bread, score, meat = np.zeros((2, 2)), np.zeros(2), np.zeros((2, 2))
        q = fn = cross = fp = npair = 0.0
        for i, g in enumerate(groups):
            a = np.sqrt(d[g])
            corr = np.full((len(g), len(g)), alpha)
            np.fill_diagonal(corr, 1)
            inv = np.linalg.inv(corr)
            xs = x[g] * a[:, None]
            u = xs.T @ inv @ r[g]
            bread += f[i] * xs.T @ inv @ xs
            score += f[i] * u
            meat += f[i] ** 2 * np.outer(u, u)
            k = len(g)
            q += f[i] * (r[g] ** 2).sum()
            fn += f[i] * k
            cross += f[i] * (r[g].sum() ** 2 - (r[g] ** 2).sum()) / 2
            fp += f[i] * k * (k - 1) / 2
            npair += k * (k - 1) / 2
        n = len(df)
        phi = q / (fn * (n - 2) / n)
        new = cross / phi / (fp * (npair - 2) / npair)
        step = np.linalg.solve(bread, score)
        cov = np.linalg.inv(bread) @ meat @ np.linalg.inv(bread)
        done = np.abs(step).max() < 1e-12 and abs(new - alpha) < 1e-12
        beta, alpha = beta + step, new
        if done:
            break
    return beta[1], math.sqrt(cov[1, 1]), alpha


@pytest.mark.parametrize("family", ["gaussian", "binomial"])
def test_exchangeable_gee_matches_matrix_form(spark, family):
    pdf = gee_frame(family)
    weight = "total" if family == "binomial" else None
    got = subject_gee(spark.createDataFrame(pdf), ["cell_type"], "y", [], family=family, weight=weight).first()
    effect, se, alpha = numpy_gee(pdf, family, pdf.total.to_numpy() if weight else None)
    assert got.status == "completed" and got.n_subjects == 20
    assert got.effect_per_10y == pytest.approx(effect, rel=1e-5)
    assert got.standard_error == pytest.approx(se, rel=1e-4)
    assert got.working_correlation == pytest.approx(alpha, rel=1e-3)
    assert got.effect_per_10y > 0 and 0 <= got.pvalue < 1


def test_independent_glm_direction_and_rank_status(spark):
    ages, score = [25.0, 35.0, 45.0, 55.0, 65.0, 75.0, 85.0, 95.0], [7.0, 6.5, 6.5, 5.0, 5.5, 4.0, 3.5, 3.0]
    pdf = pd.DataFrame({"cell_type": "W", "sample_unit_id": [f"v{i}" for i in range(8)], "age": ages,
                        "y": score, "sex": list("MMMMFFFF"), "batch": list("ppppqqqq")})
    got = independent_glm(spark.createDataFrame(pdf), ["cell_type"], "y", [], family="gaussian", weight=None).first()
    assert got.effect_per_10y == pytest.approx(np.polyfit(np.array(ages) / 10, score, 1)[0]) and got.status == "completed"
    bad = independent_glm(spark.createDataFrame(pdf), ["cell_type"], "y", ["sex", "batch"], family="gaussian", weight=None).first()
    assert bad.status == "non_estimable_rank_deficient" and bad.effect_per_10y is None


def test_design_diagnostics_and_residuals_match_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"cell_type": ["A"] * 40 + ["B"] * 30, "age": rng.uniform(20, 80, 70), "y": rng.normal(size=70),
                        "sex": rng.choice(["F", "M"], 70), "batch": rng.choice(["x", "y", "z"], 70)})
    d, x, groups = indicator_columns(age_terms(spark.createDataFrame(pdf), ["cell_type"]), ["sex", "batch"])
    got = {r.cell_type: r for r in design_diagnostics(d, ["cell_type"], x, groups, "age_decade").collect()}
    res = residualise(d, ["cell_type"], ["y"], x).select("cell_type", "age", "y_resid").toPandas()
    for t, g in pdf.groupby("cell_type"):
        dummies = pd.get_dummies(g[["sex", "batch"]], drop_first=True, dtype=float).to_numpy()
        nuisance = np.column_stack([np.ones(len(g)), dummies])
        full = np.column_stack([nuisance, (g.age - g.age.mean()) / 10])
        assert got[t].design_rank == np.linalg.matrix_rank(full) == got[t].design_columns
        assert got[t].condition_number == pytest.approx(np.linalg.cond(full), rel=1e-6)
        want = g.y - nuisance @ np.linalg.lstsq(nuisance, g.y, rcond=None)[0]
        mine = res[res.cell_type == t].sort_values("age").y_resid.to_numpy()
        assert mine == pytest.approx(want.to_numpy()[np.argsort(g.age.to_numpy())], abs=1e-9)


def test_ridge_folds_match_direct_solution(spark):
    rng = np.random.default_rng(2)
    n, width = 60, 3
    vec = rng.normal(size=(n, width))
    pdf = pd.DataFrame({"subject_id": [f"S{i % 12}" for i in range(n)], "sample_unit_id": [f"u{i}" for i in range(n)],
                        "cell_type": [str(i % 2) for i in range(n)], "age": 40 + 5 * vec[:, 0] + rng.normal(size=n)})
    pdf["vec"] = [[float(v) for v in r] for r in vec]
    rows = pr.with_folds(spark.createDataFrame(pdf), "subject_id", 4, 2)
    got = rows.toPandas()
    fits = {(r.fit_outer, r.fit_inner, r.alpha): r for r in pr.ridge_fits(rows, ["0", "1"], width, 4, 2, (1.0,)).collect()}
    for (o, i, alpha), r in fits.items():
        train = got[(got.outer_fold != o) & (got.inner_fold != i)]
        z = np.stack(train.vec.to_numpy())
        m, sd = z.mean(0), z.std(0)
        hot = np.column_stack([(train.cell_type == t).astype(float) for t in ("0", "1")])
        a = np.column_stack([(z - m) / sd, hot])
        w = 1 / train.groupby("subject_id").subject_id.transform("size").to_numpy()
        w = w / w.mean()
        am, ym = (w @ a) / w.sum(), (w @ train.age) / w.sum()
        ac, yc = a - am, train.age - ym
        beta = np.linalg.solve((ac * w[:, None]).T @ ac + alpha * np.eye(a.shape[1]), (ac * w[:, None]).T @ yc)
        assert list(r.coef) == pytest.approx(list(beta[:width] / sd), rel=1e-6)
        assert r.intercept == pytest.approx(ym - am @ beta - (beta[:width] / sd) @ m, rel=1e-6)
    folds = {r.subject_id: r.fold for r in grouped_folds(spark.createDataFrame(pdf), "subject_id", 4).collect()}
    assert len(folds) == 12 and set(folds.values()) == {0, 1, 2, 3}


def test_exact_neighbours_with_many_copies(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(700, 4)).round(2)
    base[:250] = base[0]  # a third of all rows are copies
    ids = list(range(700))
    df = spark.createDataFrame([(i, [float(v) for v in base[i]]) for i in ids], "cell_id long, vec array<float>")
    got = exact_neighbours(df, 5).toPandas()
    f32 = base.astype(np.float32).astype(float)
    dist = np.round(np.sqrt(((f32[:, None] - f32[None]) ** 2).sum(-1)), 7)
    for src in [0, 1, 249, 250, 333, 699]:
        order = sorted((dist[src, d], d) for d in ids if d != src)[:5]
        mine = got[got.src == src].sort_values("rank")
        assert mine.dist.to_numpy() == pytest.approx([v for v, _ in order], abs=1e-6)
        if order[-1][0] == 0:
            assert list(mine.dst) == [d for _, d in order]
    assert len(got) == 700 * 5


def test_seeded_take_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    take = spark.createDataFrame([(0, 700), (1, 5)], "g int, take int")
    a = {r.id for r in seeded_take(df, ["id"], take, 9, ["g"]).collect()}
    b = {r.id for r in seeded_take(df.repartition(7), ["id"], take, 9, ["g"]).collect()}
    assert a == b and len(a) == 705 and sum(i % 3 == 0 for i in a) == 5


def test_cluster_bootstrap_is_repeatable(spark):
    rows = [(20.0 + 6 * k, 20.0 + 6 * k + (-1) ** k * (k % 4), f"p{k % 7}") for k in range(14)]
    df = spark.createDataFrame(rows, "t double, p double, s string")
    a, b = (cluster_bootstrap(df.repartition(k), "s", "t", "p", 60, 0.9, 5).first() for k in (1, 3))
    assert a == b and 0 <= a.mae_ci_low < a.mae_ci_high <= 3


def test_every_batch_has_its_scenario(spark):
    rows = spark.range(1200).select(F.col("id").alias("profile_id"), F.concat(F.lit("b"), "id").alias("batch"), F.lit(5).alias("n_cells"))
    out = ex.robustness_scenarios(rows.limit(3).unionByName(rows), 3)
    assert out.select("scenario_id").distinct().count() == 1203


def test_a_gene_counts_only_in_the_types_that_keep_it(spark):
    profiles = spark.createDataFrame([("p", "A", 30), ("q", "B", 30), ("r", "B", 4)], "profile_id string, cell_type string, library_size long")
    sums = spark.createDataFrame([("p", "g", 10), ("p", "h", 20), ("q", "g", 13), ("q", "h", 17), ("r", "h", 4)], "profile_id string, gene_id string, count long")
    genes = spark.createDataFrame([("A", "g"), ("A", "h"), ("B", "g")], "cell_type string, gene_id string")
    ready, kept = ex.kept_libraries(profiles, sums, genes)
    assert {r.profile_id: r.library_size for r in ready.collect()} == {"p": 30, "q": 13}
    assert {(r.profile_id, r.gene_id) for r in kept.collect()} == {("p", "g"), ("p", "h"), ("q", "g")}


def test_voom_moderation_on_simulated_counts(spark):
    rng = np.random.default_rng(8)
    profiles = [(f"p{i}", "T", f"S{i // 2}", 30.0 + i, "F" if i % 4 < 2 else "M", "b", 100, 40 * 30) for i in range(24)]
    counts = [(f"p{i}", f"g{g}", int(rng.poisson(30 * (1.05 ** i if g == 0 else 1)))) for i in range(24) for g in range(40)]
    p = spark.createDataFrame(profiles, "profile_id string, cell_type string, subject_id string, age double, sex string, batch string, n_cells long, library_size long")
    s = spark.createDataFrame(counts, "profile_id string, gene_id string, count long")
    dense, x, groups = ex.prepare_expression(p, s, ["sex"])
    assert dense.count() == 24 * 40
    fit, weighted = ex.fixed_model(dense, x)
    rows = {r.gene_id: r for r in fit.collect()}
    assert len(rows) == 40 and rows["g0"].p_value == min(r.p_value for r in rows.values()) < 1e-6
    assert rows["g0"].effect == pytest.approx(math.log2(1.05) * 10, rel=0.2)
    qp = {r.gene_id: r for r in ex.quasi_poisson(dense, ["cell_type", "gene_id"], x, groups).collect()}
    assert qp["g0"].status == "completed" and qp["g0"].p_value < 1e-6


def test_polygamma_and_inverse():
    assert ex._polygamma(0, 1.0) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert ex._polygamma(1, 1.0) == pytest.approx(math.pi ** 2 / 6, abs=1e-9)
    assert ex._trigamma_inverse(ex._polygamma(1, 3.7)) == pytest.approx(3.7, rel=1e-8)


def test_screen_rules(spark):
    flags = ["corrected_fdr_pass", "min_support_pass", "effect_ci_excludes_zero", "sensitivity_complete_pass",
             "direction_consistency_pass", "all_sensitivity_fdr_pass", "grouping_valid", "sensitivity_grouping_valid"]
    fails = [None, "all_sensitivity_fdr_pass", "corrected_fdr_pass", "grouping_valid", "sensitivity_grouping_valid"]
    df = spark.createDataFrame([[f != bad for f in flags] for bad in fails], flags).select("*", screen_status(STRICT).alias("s"))
    assert [r.s for r in df.collect()] == ["candidate_for_human_review", "exploratory_sensitivity_limited", "not_prioritized",
                                           "not_prioritized", "exploratory_sensitivity_limited"]


def test_candidate_evidence_and_queue(spark):
    primary = spark.createDataFrame([("g1", "T", 1.0, 0.01), ("g2", "T", -1.0, 0.02), ("g3", "T", 2.0, 0.5)],
                                    "gene_id string, cell_type string, effect double, fdr_global double").withColumn("analysis_tier", F.lit("primary"))
    sens = spark.createDataFrame([("g1", "T", "drop_sex", "covariate", 0.5), ("g1", "T", "lobo_a", "leave_one_batch_out", -0.5)],
                                 "gene_id string, cell_type string, scenario_id string, scenario_type string, effect double")
    diag = spark.createDataFrame([("T", s, k, "completed") for s, k in (("drop_sex", "covariate"), ("lobo_a", "leave_one_batch_out"))],
                                 "cell_type string, scenario_id string, scenario_type string, status string")
    ev = {r.gene_id: r for r in candidate_evidence(primary, sens, diag, 0.05).collect()}
    assert set(ev) == {"g1", "g2"}
    assert ev["g1"].direction_concordance_fraction == 0.5 and ev["g1"].max_absolute_effect_change == 1.5
    assert ev["g2"].n_missing_after_expression_filter == 2 and ev["g2"].sensitivity_effect_min is None
    queue = review_queue(candidate_evidence(primary, sens, diag, 0.05), 1).collect()
    assert {(r.gene_id, r.effect_direction) for r in queue} == {("g1", "higher_with_age"), ("g2", "lower_with_age")}
    with pytest.raises(ValueError):
        review_queue(primary, 0)


def test_design_problems_name_their_columns(spark):
    from cohortroll.operators.glm import dependent_columns, design_problems, require_design

    rows = [(t, "FM"[k % 2], f"b{k % 3}", float(k), float(2 * k + 1)) for t in "AB" for k in range(12)]
    df = spark.createDataFrame(rows, "t string, sex string, batch string, x double, y double")
    require_design(df, ["t"], ["sex", "batch", "x"], "fine")
    told = lambda d, cols: {(r.t, r.problem, r.column) for r in design_problems(d, ["t"], cols).collect()}
    assert told(df, ["sex", "batch", "x", "y"]) == {("A", "dependent", "y"), ("B", "dependent", "y")}
    bad = df.withColumns({"sex": F.when(F.col("t") == "A", "F").otherwise(F.col("sex")), "x": F.when(F.col("x") == 3, None).when(F.col("x") == 4, float("nan")).otherwise(F.col("x")),
                          "batch": F.when(F.col("t") == "B", F.col("sex")).otherwise(F.col("batch"))})
    assert told(bad, ["sex", "batch", "x"]) == {("A", "no_variation", "sex"), ("A", "missing", "x"), ("A", "not_finite", "x"), ("B", "missing", "x"),
                                               ("B", "not_finite", "x"), ("B", "dependent", "batch=M")}
    with pytest.raises(ValueError, match=r"study: batch=M dependent \(10 rows in B\); sex no_variation \(12 rows in A\)|study: batch=M dependent"):
        require_design(bad, ["t"], ["sex", "batch", "x"], "study")
    with pytest.raises(ValueError, match="empty"):
        require_design(df.limit(0), ["t"], ["sex"], "study")
    assert design_problems(df, [], ["sex", "x"]).count() == 0
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = np.column_stack([np.ones(30), rng.normal(size=(30, 5))])
        at = sorted(rng.choice(np.arange(2, 6), 2, replace=False).tolist())
        for i in at:
            x[:, i] = x[:, :i] @ rng.normal(size=i)
        assert dependent_columns(x.T @ x, []) == at
