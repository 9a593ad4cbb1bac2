"""Mixed models against dense matrices: restricted likelihood, degrees of freedom by numeric derivatives, moderated tests."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortroll.functions.tails import t_two_sided_np
from cohortroll.operators import count_models as cm
from cohortroll.operators import expression as ex
from cohortroll.operators import mixed_models as mm

SCHEMA = "cell_type string, gene_id string, subject_id string, x0 double, x1 double, v double, w double"


def simulated(seed=3, n_subjects=25):
    rng, out = np.random.default_rng(seed), {}
    for gene, sd in (("g_none", 0.0), ("g_some", 0.8), ("g_more", 2.0), ("g_noisy", 0.3)):
        x, y, w, sub = [], [], [], []
        for s in range(n_subjects):
            u = rng.normal(0, sd)
            for v in range(1 + s % 3):
                x.append(rng.normal() + s / 10), w.append(rng.uniform(0.5, 2)), sub.append(s)
                y.append(1 + 0.4 * x[-1] + u + rng.normal(0, 0.5) / math.sqrt(w[-1]))
        out[gene] = [np.array(a) for a in (x, y, w, sub)]
    return out


class Dense:
    """One gene's restricted likelihood on n x n matrices, by residual variance and variance ratio."""

    def __init__(self, x, y, w, sub):
        self.x, self.y, self.w = np.column_stack([np.ones(len(x)), x]), y, w
        self.z = (sub[:, None] == np.arange(sub.max() + 1)).astype(float)

    def parts(self, ratio):
        v = np.diag(1 / self.w) + ratio * self.z @ self.z.T
        vi = np.linalg.inv(v)
        m = self.x.T @ vi @ self.x
        beta = np.linalg.solve(m, self.x.T @ vi @ self.y)
        r = self.y - self.x @ beta
        return v, m, beta, r @ vi @ r

    def loglik(self, s2, ratio):
        v, m, _, q = self.parts(ratio)
        return -0.5 * ((len(self.y) - 2) * math.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(m)[1] + q / s2)

    def optimum(self):
        profile = lambda t: self.loglik(self.parts(t)[3] / (len(self.y) - 2), t)
        grid = np.r_[0, np.geomspace(1e-4, 1e3, 300)]
        k = int(np.argmax([profile(t) for t in grid]))
        if k == 0:
            return self.parts(0)[3] / (len(self.y) - 2), 0.0
        low, high = grid[max(k - 1, 1)], grid[min(k + 1, 300)]
        for _ in range(200):  # golden section
            a, b = high - 0.618033988749895 * (high - low), low + 0.618033988749895 * (high - low)
            low, high = (low, b) if profile(a) > profile(b) else (a, high)
        t = (low + high) / 2
        return self.parts(t)[3] / (len(self.y) - 2), t

    def satterthwaite(self, s2, ratio):
        var = lambda p: p[0] * np.linalg.inv(self.parts(p[1])[1])[1, 1]
        f, at, h = (lambda p: self.loglik(*p)), np.array([s2, ratio]), np.array([s2, ratio]) * 2e-4
        grad, hess = np.zeros(2), np.zeros((2, 2))
        e = np.diag(h)
        for i in range(2):
            grad[i] = (var(at + e[i]) - var(at - e[i])) / (2 * h[i])
            for j in range(2):
                hess[i, j] = (f(at + e[i] + e[j]) - f(at + e[i] - e[j]) - f(at - e[i] + e[j]) + f(at - e[i] - e[j])) / (4 * h[i] * h[j])
        return 2 * var(at) ** 2 / (grad @ np.linalg.solve(-hess, grad))


def test_fits_are_those_on_dense_matrices(spark):
    data = simulated()
    rows = [("T", g, f"S{s}", 1.0, float(a), float(b), float(c)) for g, (x, y, w, sub) in data.items() for s, a, b, c in zip(sub, x, y, w)]
    got = {r.gene_id: r for r in mm.mixed_model(spark.createDataFrame(rows, SCHEMA).repartition(5), ["x0", "x1"], "v", "w").collect()}
    assert set(got) == set(data)
    for gene, (x, y, w, sub) in data.items():
        dense, r = Dense(x, y, w, sub), got[gene]
        s2, ratio = dense.optimum()
        assert r.variance_ratio / w.mean() == pytest.approx(ratio, rel=1e-3, abs=1e-7)
        _, m, beta, _ = dense.parts(ratio)
        assert r.effect == pytest.approx(beta[1], rel=1e-5) and r.sigma2 == pytest.approx(s2, rel=1e-4)
        assert r.standard_error == pytest.approx(math.sqrt(s2 * np.linalg.inv(m)[1, 1]), rel=1e-4)
        assert (r.n_sample_units, r.n_subjects, r.df) == (len(x), 25, len(x) - 2)
        want = dense.satterthwaite(s2, ratio) if ratio > 0 else len(x) - 2
        assert r.denominator_df == pytest.approx(want, rel=5e-3)
    assert got["g_more"].denominator_df < got["g_more"].df


def test_a_model_without_an_age_column_of_its_own_is_left_out(spark):
    rows = [("T", g, f"S{k % 5}", 1.0, 2.0 if g == "flat" else float(k % 7), float(k % 4), 1.0) for g in ("flat", "fine") for k in range(20)]
    assert [r.gene_id for r in mm.mixed_model(spark.createDataFrame(rows, SCHEMA), ["x0", "x1"], "v", "w").collect()] == ["fine"]
    assert mm.mixed_model(spark.createDataFrame([], SCHEMA), ["x0", "x1"], "v", "w").count() == 0


def test_moderated_statistics(spark):
    rng = np.random.default_rng(5)
    rows = [("T", f"g{k}", float(rng.normal()), 0.3, float(rng.chisquare(8) / 8 * 2), 8, 5.5 + k % 3) for k in range(60)]
    fit = spark.createDataFrame(rows, "cell_type string, gene_id string, effect double, unscaled_se double, sigma2 double, df int, denominator_df double")
    for r in mm.moderated_mixed_model(fit).collect():
        post = (r.prior_df * r.prior_var + r.df * r.sigma2) / (r.prior_df + r.df)
        assert r.posterior_var == pytest.approx(post) and r.moderated_t_statistic == pytest.approx(r.effect / (0.3 * math.sqrt(post)))
        assert r.total_df == pytest.approx(min(r.prior_df + r.denominator_df, 1e7))
        assert r.p_value == pytest.approx(float(t_two_sided_np(r.moderated_t_statistic, r.total_df)), rel=1e-9)
        assert np.sign(r.z_standardized) == np.sign(r.effect) and 2 * NormalDist().cdf(-abs(r.z_standardized)) == pytest.approx(r.p_value, rel=1e-9)
    tails = spark.createDataFrame([(1e-200, -1.0), (1.0, 1.0), (0.0, 1.0), (None, 1.0)], "p double, s double")
    z = [r.z for r in tails.select(mm.signed_normal("p", "s").alias("z")).collect()]
    assert z[0] < -30 and abs(z[1]) < 1e-12 and z[2] is None and z[3] is None


def test_types_with_and_without_repeated_measures(spark):
    rng = np.random.default_rng(8)
    profiles, counts = [], []
    for kind, visits in (("T", 2), ("U", 1)):
        for i in range(28):
            name = f"{kind}{i}"
            level = 30 * np.exp(0.3 * rng.normal())  # of the subject, as each has two visits in T
            c = rng.poisson(level * np.where(np.arange(40) == 0, 1.05 ** i, 1.0))
            profiles.append((name, kind, f"S{i // visits}", 30.0 + i, "F" if i % 4 < 2 else "M", "b", 100, int(c.sum())))
            counts += [(name, f"g{g}", int(v)) for g, v in enumerate(c)]
    p = spark.createDataFrame(profiles, "profile_id string, cell_type string, subject_id string, age double, sex string, batch string, n_cells long, library_size long")
    s = spark.createDataFrame(counts, "profile_id string, gene_id string, count long")
    results, about = mm.mixed_gene_models(p, s, ["sex"])
    told = {r.cell_type: r for r in about.collect()}
    assert (told["T"].status, told["T"].model_scope, told["T"].n_subjects, told["T"].n_subjects_repeated) == ("completed", "adjusted_repeated_measures", 14, 14)
    assert (told["U"].status, told["U"].reason) == ("excluded", "rank_deficient_age_absent_or_no_repeated_subjects")
    rows = {r.gene_id: r for r in results.collect()}
    assert {r.cell_type for r in rows.values()} == {"T"} and told["T"].n_genes_tested == len(rows) == 40
    best = min(rows.values(), key=lambda r: r.p_value)
    assert best.gene_id == "g0" and best.p_value < 1e-6 and best.log2_fc_per_10_years == pytest.approx(math.log2(1.05) * 10, rel=0.25)
    assert all(r.z_standardized * r.moderated_t_statistic >= 0 and r.n_sample_units == 28 for r in rows.values())


def test_scopes_of_both_models_share_the_design(spark):
    rows = [(f"p{i}", "T", f"S{i % 9}", 20.0 + i, "FM"[i % 2], "b", 10) for i in range(20)]
    p = spark.createDataFrame(rows, "profile_id string, cell_type string, subject_id string, age double, sex string, batch string, library_size long")
    scopes, used, x, _ = cm.design_scopes(p, ["sex"], min_replicates=12, min_age_span=12, min_residual_df=5)
    assert x == ["x0", "x1", "age_decade"] and used.agg(F.sum("x1")).first()[0] == 10
    assert mm.mixed_scopes(p, scopes, 12).first().reason == "insufficient_subjects"
    assert ex.design_sample_size(used, x).count() == 1
