"""Count models against direct likelihoods on dense matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortroll.operators import count_models as cm
from cohortroll.operators.glm import pairs

GAMMA = np.vectorize(math.lgamma)


def direct_fit(y, x, offset, phi, columns):
    """Coefficients, likelihood and information by plain Newton steps on a dense matrix."""
    x = x[:, columns]
    beta = np.zeros(x.shape[1])
    beta[0] = np.log((y.sum() + 0.5) / np.exp(offset).sum())
    for _ in range(200):
        mu = np.exp(x @ beta + offset)
        info = x.T @ (x * (mu / (1 + phi * mu))[:, None])
        step = np.linalg.solve(info, x.T @ ((y - mu) / (1 + phi * mu)))
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    mu = np.exp(x @ beta + offset)
    r = 1 / phi
    ll = (GAMMA(y + r) - math.lgamma(r) - GAMMA(y + 1) + y * np.log(phi * mu / (1 + phi * mu)) - r * np.log1p(phi * mu)).sum()
    ratio = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0)
    deviance = 2 * (ratio - (y + r) * np.log((1 + phi * y) / (1 + phi * mu))).sum()
    return beta, ll, np.linalg.slogdet(x.T @ (x * (mu / (1 + phi * mu))[:, None]))[1], deviance


@pytest.fixture(scope="module")
def study(spark):
    """Two types of 50 and 30 profiles, 24 genes, one with a strong trend; absent counts are left out."""
    rng = np.random.default_rng(8)
    profiles, sums = [], []
    for kind, n in (("A", 50), ("B", 30)):
        for i in range(n):
            age, sex = 20 + float(i % 25) * 2, "FM"[i % 3 == 0]
            level = rng.uniform(15, 60)
            counts = rng.negative_binomial(4, 4 / (4 + level * np.geomspace(0.6, 3, 24)))
            counts[5] = rng.negative_binomial(8, 8 / (8 + level * np.exp(0.05 * (age - 45))))
            name = f"{kind}{i:02d}"
            profiles.append((name, kind, f"S{i % 15}", age, sex, "b1" if kind == "B" else f"b{i % 2}", int(counts.sum())))
            sums += [(name, f"g{g:02d}", int(c)) for g, c in enumerate(counts) if c]
    p = spark.createDataFrame(profiles, "profile_id string, cell_type string, subject_id string, age double, sex string, batch string, library_size bigint")
    return p, spark.createDataFrame(sums, "profile_id string, gene_id string, count bigint")


def dense(rows, sums, kind):
    """Counts, design and offset of one type in one order."""
    mine = sorted((r for r in rows if r.cell_type == kind), key=lambda r: r.profile_id)
    place = {r.profile_id: k for k, r in enumerate(mine)}
    genes = sorted({r.gene_id for r in sums})
    y = np.zeros((len(genes), len(mine)))
    for r in sums:
        if r.profile_id in place:
            y[genes.index(r.gene_id), place[r.profile_id]] = r["count"]
    return genes, y, mine


def test_log_gamma():
    x = np.array([1e-6, 0.3, 1, 2.5, 7.9, 8, 55.5, 1e4, 1e9])
    assert np.allclose(cm.log_gamma(x), GAMMA(x), rtol=1e-12, atol=1e-10)


def test_likelihoods_over_blocks_and_parts_are_the_direct_ones(spark, study, monkeypatch):
    monkeypatch.setattr(cm, "BLOCK", 9)
    monkeypatch.setattr(cm, "PART", 5)
    profiles, sums = study
    d = profiles.withColumns({"x0": F.lit(1.0), "x1": (F.col("sex") == "M").cast("double"), "age_decade": (F.col("age") - 45) / 10, "norm_factor": F.lit(1.0)})
    genes = sums.join(profiles.select("profile_id", "cell_type"), "profile_id").select("cell_type", "gene_id").distinct()
    tiles = cm.tiles_of(d, sums, genes, ["x0", "x1", "age_decade"])
    assert tiles.count() > 20
    totals = cm.gene_totals(tiles)
    grid = [0.02, 0.3, 2.0]
    models = totals.select("cell_type", "part", "gene_id", "start", F.posexplode(F.array(*[F.lit(g) for g in grid])).alias("variant", "phi"))
    fits = cm.fit_models(tiles, models, 3, [[0, 1, 2]] * 3)
    apl = {(r.cell_type, r.gene_id, r.variant): r for r in cm.adjusted_profile(fits, 3).collect()}
    got = {(r.cell_type, r.gene_id, r.variant): r for r in fits.collect()}
    rows, counts = d.collect(), sums.collect()
    start = {(r.cell_type, r.gene_id): r for r in totals.collect()}
    for kind in "AB":
        names, y, mine = dense(rows, counts, kind)
        x = np.array([[1.0, r.x1, r.age_decade] for r in mine])
        offset = np.log([float(r.library_size) for r in mine])
        for g, name in enumerate(names):
            assert start[kind, name].start == pytest.approx(np.log((y[g].sum() + 0.5) / np.exp(offset).sum()))
            for v, phi in enumerate(grid):
                beta, ll, logdet, deviance = direct_fit(y[g], x, offset, phi, [0, 1, 2])
                one = got[kind, name, v]
                assert one.converged and np.allclose(one.beta, beta, atol=2e-4)
                assert apl[kind, name, v].apl == pytest.approx(ll - logdet / 2, abs=1e-5)
                k = len(pairs(3))
                assert 2 * (one.s[k + 5] - one.s[k + 3]) == pytest.approx(deviance, abs=1e-5)


def test_test_statistic_trend_and_scopes(spark, study):
    profiles, sums = study
    flat = profiles.where("cell_type = 'A'").select(F.concat(F.lit("C"), "profile_id").alias("profile_id"), F.lit("C").alias("cell_type"),
                                                    "subject_id", F.lit(40.0).alias("age"), "sex", "batch", "library_size")
    few = profiles.where("cell_type = 'A'").limit(5).withColumns({"cell_type": F.lit("D"), "profile_id": F.concat(F.lit("D"), "profile_id")})
    everyone = profiles.unionByName(flat).unionByName(few)
    # In type B batch repeats sex, so only age can be estimated there.
    everyone = everyone.withColumn("batch", F.when(F.col("cell_type") == "B", F.col("sex")).otherwise(F.col("batch")))
    counts = sums.unionByName(sums.where("profile_id like 'A%'").withColumn("profile_id", F.concat(F.lit("C"), "profile_id")))
    results, about = cm.count_models(everyone, counts, ["sex", "batch"], min_replicates=12, min_age_span=12, grid=[0.03 * 2.0**k for k in range(7)])
    told = {r.cell_type: r for r in about.collect()}
    assert [(k, told[k].model_scope, told[k].status, told[k].reason) for k in "ABCD"] == [
        ("A", "adjusted_primary", "completed", ""), ("B", "age_only_sensitivity", "completed", ""),
        ("C", "not_tested", "excluded", "insufficient_age_span"), ("D", "not_tested", "excluded", "insufficient_replicates")]
    assert (told["A"].design_columns, told["A"].design_rank, told["A"].residual_df) == (4, 4, 46)
    assert (told["B"].design_columns, told["B"].design_rank, told["B"].residual_df) == (2, 2, 28)
    rows = results.collect()
    assert {r.cell_type for r in rows} == {"A", "B"} and all(r.converged and 0 <= r.p_value <= 1 for r in rows)
    for kind in "AB":
        mine = [r for r in rows if r.cell_type == kind]
        assert told[kind].n_genes_tested == len(mine)
        best = min(mine, key=lambda r: r.p_value)
        assert best.gene_id == "g05" and best.log2_fc_per_10_years == pytest.approx(0.5 / math.log(2), abs=0.25)
        assert sorted(r.p_value for r in mine)[1] > 1e-4
        assert all(0.05 < r.trended_dispersion < 1 for r in mine)  # counts were drawn with 1/4
        for r in mine:
            lone = r.deviance / r.residual_df
            assert min(lone, r.ql_dispersion) <= r.ql_dispersion and r.ql_f_statistic == pytest.approx((r.null_deviance - r.deviance) / r.ql_dispersion, abs=1e-9)


def test_shared_likelihood_is_the_weighted_mean_over_genes():
    rng = np.random.default_rng(0)
    at, n, sums = np.sort(rng.choice(np.arange(200), 40, replace=False)).astype(float), rng.integers(1, 5, 40).astype(float), rng.normal(size=(40, 3))
    near = cm.local_means(at, n, sums, 0.4)
    for i in (0, 17, 39):
        genes = np.repeat(np.abs(at - at[i]), n.astype(int))  # one entry for each gene
        reach = np.sort(genes)[int(np.ceil(0.4 * len(genes))) - 1] * 1.001
        w = np.clip(1 - (np.abs(at - at[i]) / reach) ** 3, 0, None) ** 3
        assert np.allclose(near[i], (w[:, None] * sums).sum(0) / (w * n).sum())
    assert np.allclose(cm.local_means(np.array([3.0]), np.array([2.0]), np.array([[4.0, 6.0]]), 0.5), [[2.0, 3.0]])


def test_peaks_of_parabolas():
    x = np.arange(7.0)
    rows = np.stack([-(x - 2.3) ** 2, -(x - 5.9) ** 2, x, -x])
    assert np.allclose(cm.peak(rows), [2.3, 5.9, 6.0, 0.0])


def test_nothing_to_test(spark, study):
    profiles, sums = study
    results, about = cm.count_models(profiles, sums.where("count > 1000000"), ["sex"], grid=[0.1, 0.2, 0.4])
    assert results.count() == 0 and {(r.status, r.n_genes_tested) for r in about.collect()} == {("model_failed", 0)}


def test_rows_unfold_into_scenarios_without_a_join(spark):
    """Rows under the scenarios of their profiles are those of a join, and no table of profiles under scenarios is broadcast."""
    from cohortroll.operators import expression as ex

    profiles = spark.createDataFrame([(f"p{i}", "B" + "xyz"[i % 3] if i else None, i % 5) for i in range(12)], "profile_id string, batch string, n_cells int")
    rows = profiles.where("batch <> 'Bz'").join(spark.range(2).withColumnRenamed("id", "gene_id"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = ex.robustness_scenarios(rows, 3, profiles)
    told = ex.robustness_scenarios(profiles, 3).drop("batch", "n_cells")
    key = lambda df: sorted(map(str, df.select("profile_id", "gene_id", "scenario_id", "use_sex", "use_batch").collect()))
    assert key(got) == key(rows.join(told, "profile_id")) and any("leave_out_Bz" in r for r in key(got))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_dealt_by_number_and_models_go_to_them(spark, study, monkeypatch):
    monkeypatch.setattr(cm, "BLOCK", 9)
    monkeypatch.setattr(cm, "PART", 5)
    monkeypatch.setattr(cm, "TILES", 2, raising=False)
    profiles, sums = study
    d = profiles.withColumns({"x0": F.lit(1.0), "age_decade": (F.col("age") - 45) / 10, "norm_factor": F.lit(1.0)})
    genes = sums.join(profiles.select("profile_id", "cell_type"), "profile_id").select("cell_type", "gene_id").distinct()
    tiles = cm.tiles_of(d, sums, genes, ["x0", "age_decade"])
    n = tiles.count()
    assert tiles.select(F.input_file_name()).distinct().count() > n / 6  # small as they are, tiles are work for many tasks
    models = cm.gene_totals(tiles).select("cell_type", "part", "gene_id", F.lit(0).alias("variant"), F.lit(0.3).alias("phi"), "start")
    known = lambda: {(r.cell_type, r.gene_id): list(r.beta) + list(r.s) for r in cm.fit_models(tiles, models, 2, [[0, 1]]).collect()}
    sent = known()
    monkeypatch.setattr(cm, "SENT", 0, raising=False)  # more models than are sent to all tasks
    met = known()
    assert len(sent) == 48 and sent.keys() == met.keys()
    assert all(sent[k] == pytest.approx(met[k], rel=1e-9, abs=1e-9) for k in sent)
    y, phi = np.random.default_rng(2).integers(0, 30, (40, 60)).astype(float), np.repeat([0.1, 0.7], 20)[:, None]
    free, whole = cm.count_terms(y, phi)
    assert free == pytest.approx(GAMMA(y + 1 / phi) - GAMMA(1 / phi) - GAMMA(y + 1) + y * np.log(phi), rel=1e-10, abs=1e-10)
    assert whole == pytest.approx(np.where(y > 0, y * np.log(np.where(y > 0, y, 1)), 0) - (y + 1 / phi) * np.log1p(phi * y), rel=1e-12)
