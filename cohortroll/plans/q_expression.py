"""Per-gene expression models over the order star, with brands as genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortroll.operators import count_models as cm
from cohortroll.operators import expression as ex
from cohortroll.operators import mixed_models as mm
from cohortroll.operators.ordering import bh_fdr
from cohortroll.operators.rollup import pseudobulk_sums
from cohortroll.operators.stats import age_terms
from cohortroll.plans import bindings as b
from cohortroll.plans.registry import query
from cohortroll.session import keep

PROFILE_SQL = f"""{b.CELLS_B}, {b.COUNTS_BRAND}, lib AS (SELECT cell_id, sum(count) AS lib FROM counts GROUP BY 1), profiles AS (SELECT
 sample_unit_id || '|' || cell_type AS profile_id, cell_type, min(subject_id) AS subject_id, min(age) AS age, min(sex) AS sex, min(batch) AS batch,
 count(*) AS n_cells, sum(lib)::BIGINT AS library_size FROM cells LEFT JOIN lib USING (cell_id) GROUP BY sample_unit_id, cell_type HAVING count(*) >= 2
 AND sum(lib) > 0), sums AS (SELECT sample_unit_id || '|' || cell_type AS profile_id, gene_id, sum(count)::BIGINT AS count FROM counts JOIN cells USING
 (cell_id) GROUP BY ALL), xp AS (SELECT *, (age - avg(age) OVER (PARTITION BY cell_type)) / 10 AS x FROM profiles)"""


def inputs(spark, folder):
    """Profiles with at least two cells and a library, and their summed counts per brand."""
    cells = b.cells_b(spark, folder).withColumn("profile_id", F.concat_ws("|", "sample_unit_id", "cell_type"))
    counts = b.counts_b(spark, folder, "brand")
    sums = keep(pseudobulk_sums(counts, cells, ["profile_id"]), "sums")
    lib = sums.groupBy("profile_id").agg(F.sum("count").alias("library_size"))
    profiles = cells.groupBy("profile_id", "cell_type").agg(
        *[F.min(c).alias(c) for c in ("subject_id", "age", "sex", "batch")], F.count(F.lit(1)).alias("n_cells"))
    profiles = keep(profiles.where("n_cells >= 2").join(lib.where("library_size > 0"), "profile_id"), "profiles")
    return profiles, sums.join(profiles.select("profile_id"), "profile_id", "left_semi")


PLANTED = "CASE cell_type WHEN 'P' THEN sex ELSE batch END AS batch, CASE cell_type WHEN 'O' THEN 40.0 ELSE age END AS age"


def planted_designs(profiles):
    """In type P the batch repeats the sex, so covariates can't be told apart; in type O all ages are one."""
    kind = F.col("cell_type")
    return profiles.withColumns({"batch": F.when(kind == "P", F.col("sex")).otherwise(F.col("batch")),
                                 "age": F.when(kind == "O", F.lit(40.0)).otherwise(F.col("age"))})


@query("leverage_sample_size", f"""WITH {PROFILE_SQL}, l AS (SELECT cell_type, 1 / max(1.0 / n + x * x / sxx) AS n0 FROM xp JOIN (SELECT cell_type,
 count(*) AS n, sum(x * x) AS sxx FROM xp GROUP BY 1) USING (cell_type) GROUP BY 1) SELECT cell_type, round(CASE WHEN n0 > 10 THEN 10 + (n0 - 10) * 0.7
 ELSE n0 END, 5) AS min_samples FROM l""")
def leverage_sample_size(spark, folder):
    profiles, _ = inputs(spark, folder)
    return b.rounded(ex.leverage_sample_size(profiles, []), 5)


@query("expressed_genes", f"""WITH {PROFILE_SQL}, l AS (SELECT cell_type, 1 / max(1.0 / n + x * x / sxx) AS n0 FROM xp JOIN (SELECT cell_type,
 count(*) AS n, sum(x * x) AS sxx FROM xp GROUP BY 1) USING (cell_type) GROUP BY 1), m AS (SELECT cell_type, 10 / median(library_size) * 1e6 AS cutoff FROM
 profiles GROUP BY 1), g AS (SELECT p.cell_type, gene_id, count(*) FILTER (count * 1e6 / library_size >= cutoff) AS n_above, sum(count)::BIGINT AS total FROM
 sums JOIN profiles p USING (profile_id) JOIN m ON m.cell_type = p.cell_type GROUP BY ALL) SELECT g.* FROM g JOIN l USING (cell_type) WHERE n_above >=
 CASE WHEN n0 > 10 THEN 10 + (n0 - 10) * 0.7 ELSE n0 END AND total >= 15""")
def expressed_genes(spark, folder):
    profiles, sums = inputs(spark, folder)
    return ex.expressed_genes(profiles, sums, ex.leverage_sample_size(profiles, []))


KEPT_SQL = """l AS (SELECT cell_type, 1 / max(1.0 / n + x * x / sxx) AS n0 FROM xp JOIN (SELECT cell_type, count(*) AS n, sum(x * x) AS sxx FROM xp
 GROUP BY 1) USING (cell_type) GROUP BY 1), m AS (SELECT cell_type, 10 / median(library_size) * 1e6 AS cutoff FROM profiles GROUP BY 1), g AS (SELECT
 p.cell_type, gene_id, count(*) FILTER (count * 1e6 / library_size >= cutoff) AS n_above, sum(count)::BIGINT AS total FROM sums JOIN profiles p USING
 (profile_id) JOIN m ON m.cell_type = p.cell_type GROUP BY ALL), kg AS (SELECT g.cell_type, gene_id FROM g JOIN l USING (cell_type) WHERE n_above >= CASE
 WHEN n0 > 10 THEN 10 + (n0 - 10) * 0.7 ELSE n0 END AND total >= 15), ks AS (SELECT profile_id, cell_type, gene_id, count FROM sums JOIN profiles USING
 (profile_id) JOIN kg USING (cell_type, gene_id)), kl AS (SELECT profile_id, sum(count)::BIGINT AS library_size FROM ks GROUP BY 1)"""


@query("filtered_log_cpm", f"""WITH {PROFILE_SQL}, {KEPT_SQL} SELECT profile_id, cell_type, gene_id, count, kl.library_size, round(log2((count + 0.5) /
 (kl.library_size + 1) * 1e6), 8) AS log_cpm FROM ks JOIN kl USING (profile_id)""")
def filtered_log_cpm(spark, folder):
    """Log-CPM of the counts that pass the gene filter of their type, by libraries of those counts."""
    profiles, sums = inputs(spark, folder)
    genes = ex.expressed_genes(profiles, sums, ex.leverage_sample_size(profiles, []))
    profiles, kept = ex.kept_libraries(profiles, sums, genes)
    rows = kept.join(profiles.select("profile_id", "cell_type", "library_size"), "profile_id").withColumn("norm_factor", F.lit(1.0))
    return ex.log_cpm(rows).select("profile_id", "cell_type", "gene_id", "count", "library_size", F.round("log_cpm", 8).alias("log_cpm"))


TMM_SQL = """s AS (SELECT profile_id, cell_type, library_size AS lib, gene_id, count FROM sums JOIN profiles USING (profile_id)), gn AS (SELECT DISTINCT
 cell_type, gene_id FROM s), q AS (SELECT p.profile_id, p.cell_type, quantile_cont(coalesce(count, 0), 0.75) / any_value(p.library_size) AS q FROM profiles p
 JOIN gn ON gn.cell_type = p.cell_type LEFT JOIN sums ON sums.profile_id = p.profile_id AND sums.gene_id = gn.gene_id GROUP BY ALL), r AS (SELECT cell_type,
 profile_id AS ref FROM q JOIN (SELECT cell_type, avg(q) AS m FROM q GROUP BY 1) USING (cell_type) QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY
 round(abs(q - m), 12), profile_id) = 1), rc AS (SELECT s.cell_type, gene_id, count AS rc, lib AS rl FROM s JOIN r ON r.ref = s.profile_id), j AS (SELECT
 s.cell_type, profile_id, round(log2((count / lib) / (rc / rl)), 12) AS m, round((log2(count / lib) + log2(rc / rl)) / 2, 12) AS a, (lib - count) / lib / count +
 (rl - rc) / rl / rc AS v FROM s JOIN rc USING (cell_type, gene_id)), k AS (SELECT *, count(*) OVER (PARTITION BY profile_id) AS n, rank() OVER (PARTITION BY
 profile_id ORDER BY m) + (count(*) OVER (PARTITION BY profile_id, m) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY profile_id ORDER BY a) + (count(*) OVER
 (PARTITION BY profile_id, a) - 1) / 2.0 AS ra FROM j), f AS (SELECT profile_id, sum(m / v) / sum(1 / v) AS lf FROM k WHERE rm >= floor(n * 0.3) + 1 AND rm <= n -
 floor(n * 0.3) AND ra >= floor(n * 0.05) + 1 AND ra <= n - floor(n * 0.05) AND v > 0 GROUP BY 1), lf AS (SELECT p.profile_id, p.cell_type, p.library_size,
 coalesce(lf, 0) AS lf FROM profiles p LEFT JOIN f USING (profile_id)), tmm AS (SELECT profile_id, cell_type, library_size, 2 ** (lf - avg(lf) OVER (PARTITION BY
 cell_type)) AS norm_factor FROM lf)"""


@query("tmm_factors", f"WITH {PROFILE_SQL}, {TMM_SQL} SELECT profile_id, cell_type, library_size, round(norm_factor, 7) AS norm_factor FROM tmm")
def tmm_factors(spark, folder):
    profiles, sums = inputs(spark, folder)
    return b.rounded(ex.tmm_factors(profiles, sums), 7)


@query("log_cpm_lines", f"""WITH {PROFILE_SQL}, d AS (SELECT xp.cell_type, g.gene_id, x, log2((coalesce(count, 0) + 0.5) / (library_size + 1) * 1e6) AS y
 FROM xp JOIN (SELECT DISTINCT cell_type, gene_id FROM sums JOIN profiles USING (profile_id)) g ON g.cell_type = xp.cell_type LEFT JOIN sums ON
 sums.profile_id = xp.profile_id AND sums.gene_id = g.gene_id) SELECT cell_type, gene_id, count(*) AS n, round(avg(y), 7) AS average_log_cpm,
 round(regr_slope(y, x), 6) AS effect, round((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2), 5) AS sigma2 FROM d GROUP BY ALL""")
def log_cpm_lines(spark, folder):
    profiles, sums = inputs(spark, folder)
    genes = sums.join(profiles.select("profile_id", "cell_type"), "profile_id").select("cell_type", "gene_id").distinct()
    d = age_terms(profiles, ["cell_type"]).withColumn("x0", F.lit(1.0)).withColumn("norm_factor", F.lit(1.0))
    out = ex.gene_lines(ex.log_cpm(ex.dense_counts(d, sums, genes)), ["x0", "age_decade"], "log_cpm")
    return out.select("cell_type", "gene_id", "n", F.round("average_log_cpm", 7).alias("average_log_cpm"),
                      F.round("effect", 6).alias("effect"), F.round("sigma2", 5).alias("sigma2"))


def _with_fdr(out, p="p_value"):
    return bh_fdr(keep(out, "results"), p, {"fdr_within_celltype": ["cell_type"], "fdr_global": []})


@query("moderated_gene_models")
def moderated_gene_models(spark, folder):
    dense, x, _ = ex.prepare_expression(*inputs(spark, folder), ["sex"])
    fit, _ = ex.fixed_model(dense, x)
    return _with_fdr(fit.select("cell_type", "gene_id", F.col("effect").alias("log2_fc_per_10_years"), "average_log_cpm",
                                "moderated_t", "df", "prior_df", "prior_var", "p_value"))


@query("mixed_gene_models")
def mixed_gene_models(spark, folder):
    """Moderated random-intercept tests with the planted designs of ``count_model_scopes``."""
    profiles, sums = inputs(spark, folder)
    results, _ = mm.mixed_gene_models(planted_designs(profiles), sums, ["sex", "batch"])
    return _with_fdr(ex.effect_interval(results))


@query("mixed_model_scopes", f"""WITH {PROFILE_SQL}, q AS (SELECT cell_type, subject_id, sex, {PLANTED} FROM profiles), k AS (SELECT cell_type, subject_id, count(*)
 AS k FROM q GROUP BY ALL), r AS (SELECT cell_type, count(*) AS n_subjects, count(*) FILTER (k > 1) AS n_subjects_repeated, max(k) AS max_samples_per_subject FROM
 k GROUP BY 1), s AS (SELECT cell_type, count(*) AS n_sample_units, max(age) - min(age) AS age_span_years, count(DISTINCT sex) AS n_sex, count(DISTINCT batch) AS
 n_batch, count(DISTINCT sex || batch) AS n_both FROM q GROUP BY 1) SELECT cell_type, n_sample_units, n_subjects, n_subjects_repeated, max_samples_per_subject,
 age_span_years, CASE WHEN n_sample_units < 12 THEN 'insufficient_sample_units' WHEN age_span_years < 12 THEN 'insufficient_age_span' WHEN n_subjects < 12 THEN
 'insufficient_subjects' WHEN (n_both = n_sex AND n_both = n_batch AND n_sex > 1) OR n_subjects_repeated < 1 THEN
 'rank_deficient_age_absent_or_no_repeated_subjects' ELSE '' END AS reason, CASE WHEN reason = '' THEN 'adjusted_repeated_measures' ELSE 'not_tested' END AS
 model_scope, CASE WHEN reason = '' THEN 'completed' ELSE 'excluded' END AS status FROM s JOIN r USING (cell_type)""")
def mixed_model_scopes(spark, folder):
    """Which types have a mixed model, and why the others have none."""
    profiles, _ = inputs(spark, folder)
    planted = keep(planted_designs(profiles), "planted")
    scopes, _, _, _ = cm.design_scopes(planted, ["sex", "batch"], min_replicates=12, min_age_span=12, min_residual_df=5)
    return mm.mixed_scopes(planted, scopes, 12)


@query("quasi_poisson_gene_models")
def quasi_poisson_gene_models(spark, folder):
    dense, x, groups = ex.prepare_expression(*inputs(spark, folder), ["sex"])
    return _with_fdr(ex.quasi_poisson(dense, ["cell_type", "gene_id"], x, groups))


@query("robustness_scenarios", f"""WITH {PROFILE_SQL}, sc AS (SELECT 'high_cell_support' AS scenario_id, 'cell_support' AS scenario_type, '' AS excluded_batch
 UNION ALL SELECT 'drop_sex', 'covariate', '' UNION ALL SELECT 'drop_batch', 'covariate', '' UNION ALL SELECT DISTINCT 'leave_out_' || batch,
 'leave_one_batch_out', batch FROM profiles) SELECT scenario_id, scenario_type, excluded_batch, cell_type, count(*) AS n_profiles FROM profiles CROSS JOIN sc
 WHERE (scenario_id <> 'high_cell_support' OR n_cells >= 3) AND batch <> excluded_batch GROUP BY ALL""")
def robustness_scenarios(spark, folder):
    profiles, _ = inputs(spark, folder)
    out = ex.robustness_scenarios(profiles, 3)
    return out.groupBy("scenario_id", "scenario_type", "excluded_batch", "cell_type").agg(F.count(F.lit(1)).alias("n_profiles"))


@query("robustness_refits")
def robustness_refits(spark, folder):
    """Quasi-Poisson refits of the strongest quarter of primary results under every scenario."""
    profiles, sums = inputs(spark, folder)
    d, kept, genes, x, groups = ex.prepare_counts(profiles, sums, ["sex", "batch"])
    folded = ex.folded_counts(d, kept, genes, x, 3)
    primary = keep(ex.folded_quasi_poisson(folded, ["cell_type", "gene_id"], x, groups), "primary")
    cols = [[x[i] for i in g] for g in groups]
    return ex.scenario_models(folded, profiles, 3, primary.where("p_value < 0.25"), x, groups, cols[0], cols[1])


@query("count_model_scopes", f"""WITH {PROFILE_SQL}, q AS (SELECT cell_type, sex, {PLANTED} FROM profiles), s AS (SELECT cell_type, count(*) AS n_replicates,
 max(age) - min(age) AS age_span_years, count(DISTINCT sex) AS n_sex, count(DISTINCT batch) AS n_batch, count(DISTINCT sex || batch) AS n_both FROM q
 GROUP BY 1), t AS (SELECT *, CASE WHEN n_replicates < 12 THEN 'insufficient_replicates' WHEN age_span_years < 12 THEN 'insufficient_age_span' ELSE '' END AS
 reason, n_sex + n_batch AS wide, n_both = n_sex AND n_both = n_batch AND n_sex > 1 AS same FROM s) SELECT cell_type, n_replicates, age_span_years, reason,
 CASE WHEN reason <> '' THEN 'not_tested' WHEN same OR n_replicates - wide < 5 THEN 'age_only_sensitivity' ELSE 'adjusted_primary' END AS model_scope, CASE WHEN
 reason <> '' THEN NULL WHEN same OR n_replicates - wide < 5 THEN 2 ELSE wide END::INTEGER AS design_columns, CASE WHEN reason <> '' THEN NULL WHEN same OR
 n_replicates - wide < 5 THEN 2 ELSE wide END::INTEGER AS design_rank, (n_replicates - design_rank)::INTEGER AS residual_df, CASE WHEN reason = '' THEN
 'completed' ELSE 'excluded' END AS status FROM t""")
def count_model_scopes(spark, folder):
    """Which design each type is tested with, with a type whose covariates can't be estimated and one without an age span."""
    profiles, _ = inputs(spark, folder)
    scopes, _, _, _ = cm.design_scopes(planted_designs(profiles), ["sex", "batch"], min_replicates=12, min_age_span=12, min_residual_df=5)
    return scopes


PHIS = (0.5, 5.0, 50.0)


def scoring_sql(rounds: int) -> str:
    """Fisher scoring of a line in the log mean, one round below the other."""
    out = []
    for i in range(rounds):
        out.append(f"""m{i} AS MATERIALIZED (SELECT cell_type, gene_id, phi, sum(w) AS a, sum(w * x) AS b, sum(w * x * x) AS c, sum(r) AS u, sum(r * x) AS v FROM (SELECT
 d.cell_type, d.gene_id, phi, x, mu / (1 + phi * mu) AS w, (y - mu) / (1 + phi * mu) AS r FROM (SELECT d.*, phi, exp(o + b0 + b1 * x) AS mu FROM d JOIN s{i}
 USING (cell_type, gene_id)) d) GROUP BY ALL), s{i + 1} AS MATERIALIZED (SELECT cell_type, gene_id, phi, b0 + (c * u - b * v) / (a * c - b * b) AS b0, b1 + (a * v
 - b * u) / (a * c - b * b) AS b1 FROM s{i} JOIN m{i} USING (cell_type, gene_id, phi))""")
    return ", ".join(out)


@query("dispersion_likelihoods", f"""WITH {PROFILE_SQL}, d AS MATERIALIZED (SELECT xp.cell_type, g.gene_id, x, ln(library_size) AS o, coalesce(count, 0)::DOUBLE AS y
 FROM xp JOIN (SELECT DISTINCT cell_type, gene_id FROM sums JOIN profiles USING (profile_id)) g ON g.cell_type = xp.cell_type LEFT JOIN sums ON
 sums.profile_id = xp.profile_id AND sums.gene_id = g.gene_id), s0 AS MATERIALIZED (SELECT cell_type, gene_id, phi, ln((sum(y) + 0.5) / sum(exp(o))) AS b0,
 0.0::DOUBLE AS b1 FROM d, (SELECT unnest([{", ".join(map(str, PHIS))}]::DOUBLE[]) AS phi) GROUP BY ALL), {scoring_sql(20)}, f AS (SELECT d.cell_type,
 d.gene_id, phi, b1, y, x, exp(o + b0 + b1 * x) AS mu FROM d JOIN s20 USING (cell_type, gene_id)) SELECT cell_type, gene_id, phi, round(any_value(b1) / ln(2), 5)
 AS log2_fc_per_10_years, round(sum(lgamma(y + 1 / phi) - lgamma(1 / phi) - lgamma(y + 1) + y * ln(phi * mu / (1 + phi * mu)) - ln(1 + phi * mu) / phi) - 0.5 *
 ln(sum(mu / (1 + phi * mu)) * sum(x * x * mu / (1 + phi * mu)) - sum(x * mu / (1 + phi * mu)) ** 2), 4) AS adjusted_likelihood, round(2 * sum(CASE WHEN y > 0
 THEN y * ln(y / mu) ELSE 0 END - (y + 1 / phi) * ln((1 + phi * y) / (1 + phi * mu))), 4) AS deviance FROM f GROUP BY ALL""")
def dispersion_likelihoods(spark, folder):
    """Age effect, adjusted profile likelihood and deviance of every gene of every type at three dispersions, age alone in the design."""
    profiles, sums = inputs(spark, folder)
    genes = sums.join(profiles.select("profile_id", "cell_type"), "profile_id").select("cell_type", "gene_id").distinct()
    d = age_terms(profiles, ["cell_type"]).withColumns({"x0": F.lit(1.0), "norm_factor": F.lit(1.0)})
    tiles = cm.tiles_of(d, sums, genes, ["x0", "age_decade"])
    models = cm.gene_totals(tiles).select(
        "cell_type", "part", "gene_id", "start", F.posexplode(F.array(*[F.lit(v) for v in PHIS])).alias("variant", "phi"))
    fits = cm.fit_models(tiles, models, 2, [[0, 1]] * len(PHIS), tolerance=-1.0, still=1e-9)
    apl = cm.adjusted_profile(fits, 2).select(*cm.MODEL, "apl")
    return fits.join(apl, cm.MODEL).select(
        "cell_type", "gene_id", "phi", F.round(F.col("beta")[1] / F.log(F.lit(2.0)), 5).alias("log2_fc_per_10_years"),
        F.round("apl", 4).alias("adjusted_likelihood"), F.round(2 * (F.col("s")[7] - F.col("s")[5]), 4).alias("deviance"))


@query("count_gene_models")
def count_gene_models(spark, folder):
    """Negative-binomial quasi-likelihood tests with the planted designs of ``count_model_scopes``."""
    profiles, sums = inputs(spark, folder)
    results, _ = cm.count_models(planted_designs(profiles), sums, ["sex", "batch"])
    return _with_fdr(results)
