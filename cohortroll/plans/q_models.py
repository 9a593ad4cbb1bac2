"""Association models: trends over age per cell type and per gene set."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortroll.functions.scalar import direction_label
from cohortroll.functions.tails import t_two_sided
from cohortroll.operators.association import (
    associations, earliest_samples, gee_with_fallback, independent_glm, subject_gee)
from cohortroll.operators.glm import design_diagnostics, design_problems, gramian, indicator_columns, pairs, residualise
from cohortroll.operators.ordering import bh_fdr
from cohortroll.operators.rollup import sample_fractions, signature_means
from cohortroll.operators.stats import age_terms, clustered_age_effect, demean, linear_fit, pearson, residual_violations, spearman
from cohortroll.plans import bindings as b
from cohortroll.plans.registry import query
from cohortroll.session import keep

MIN_CELLS = 5

FRACTIONS_SQL = f"""{b.CELLS_A},
totals AS (SELECT sample_unit_id, count(*) AS total_cells, median(age) AS age,
  min(subject_id) AS subject_id FROM cells GROUP BY 1 HAVING count(*) >= {MIN_CELLS}),
kinds AS (SELECT DISTINCT cell_type FROM cells SEMI JOIN totals USING (sample_unit_id)),
counted AS (SELECT sample_unit_id, cell_type, count(*) AS n FROM cells GROUP BY 1, 2),
fractions AS (SELECT t.*, k.cell_type, coalesce(n, 0)::BIGINT AS n_cells,
  coalesce(n, 0) / total_cells AS fraction
 FROM totals t CROSS JOIN kinds k LEFT JOIN counted c
   ON c.sample_unit_id = t.sample_unit_id AND c.cell_type = k.cell_type)"""

RANKED_SQL = """ranked AS (SELECT *,
  rank() OVER (PARTITION BY cell_type ORDER BY age)
   + (count(*) OVER (PARTITION BY cell_type, age) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY cell_type ORDER BY fraction)
   + (count(*) OVER (PARTITION BY cell_type, fraction) - 1) / 2.0 AS ry FROM fractions)"""


def fractions(spark, folder):
    return keep(sample_fractions(b.cells_a(spark, folder), min_cells=MIN_CELLS), "fractions")


@query("composition_trend", f"""WITH {FRACTIONS_SQL}, {RANKED_SQL}
SELECT cell_type, count(*) AS n_samples, count(DISTINCT subject_id) AS n_subjects,
 count(*) FILTER (n_cells > 0) AS n_samples_detected,
 count(DISTINCT subject_id) FILTER (n_cells > 0) AS n_subjects_detected,
 round(avg(fraction), 8) AS mean_fraction, round(corr(rx, ry), 8) AS spearman_rho,
 round(regr_slope(fraction, age), 8) AS slope_per_year,
 round(regr_slope(fraction, age) * 10, 8) AS slope_per_10y,
 round(regr_r2(fraction, age), 8) AS r_squared,
 CASE WHEN regr_slope(fraction, age) > 0 THEN 'increase_with_age' ELSE 'decrease_with_age' END
  AS direction
FROM ranked GROUP BY cell_type""")
def composition_trend(spark, folder):
    f = fractions(spark, folder)
    seen = F.col("n_cells") > 0
    support = f.groupBy("cell_type").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_distinct("subject_id").alias("n_subjects"),
        F.count_if(seen).alias("n_samples_detected"),
        F.count_distinct(F.when(seen, F.col("subject_id"))).alias("n_subjects_detected"),
        F.avg("fraction").alias("mean_fraction"))
    fit = linear_fit(f, ["cell_type"], "age", "fraction").select(
        "cell_type", F.col("slope").alias("slope_per_year"),
        (F.col("slope") * 10).alias("slope_per_10y"), "r_squared",
        direction_label("slope").alias("direction"))
    rho = spearman(f, ["cell_type"], "age", "fraction")
    return b.rounded(support.join(fit, "cell_type").join(rho, "cell_type"), 8)


@query("bh_fdr_by_type_and_global", f"""WITH {b.CELLS_A},
p AS (SELECT cell_id, cell_type, value / 500 AS p FROM cells),
w AS (SELECT *, rank() OVER (PARTITION BY cell_type ORDER BY p) + count(*) OVER
   (PARTITION BY cell_type, p) - 1 AS r, count(*) OVER (PARTITION BY cell_type) AS m,
  rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS gr, count(*) OVER () AS gm FROM p)
SELECT cell_id, cell_type, round(least(1, min(p * m / r) OVER (PARTITION BY cell_type ORDER BY p
  DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS fdr_within_celltype,
 round(least(1, min(p * gm / gr) OVER (ORDER BY p DESC
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS fdr_global FROM w""")
def bh_two_levels(spark, folder):
    p = b.cells_a(spark, folder).select("cell_id", "cell_type", F.col("confidence").alias("p"))
    out = bh_fdr(p, "p", {"fdr_within_celltype": ["cell_type"], "fdr_global": []})
    return b.rounded(out.drop("p"), 9)


# ---- regressions -----------------------------------------------------------------------------

SAMPLES_SQL = f"""{b.CELLS_B}, samples AS (SELECT sample_unit_id, cell_type, min(subject_id) AS subject_id, min(age) AS age,
 min(sex) AS sex, min(batch) AS batch, round(avg(value) / 1000, 6) AS score, count(*) AS n_cells FROM cells GROUP BY ALL)"""


def samples(spark, folder):
    """Order star rolled to sample unit x type: one outcome per row, rounded to keep input exact."""
    return keep(b.cells_b(spark, folder).groupBy("sample_unit_id", "cell_type").agg(
        *[F.min(c).alias(c) for c in ("subject_id", "age", "sex", "batch")],
        F.round(F.avg("value") / 1000, 6).alias("score"), F.count(F.lit(1)).alias("n_cells")), "samples")


@query("guarded_correlation", f"""WITH {b.CELLS_B} SELECT batch, sex, CASE WHEN stddev_pop(v) > 0 THEN round(corr(age, v), 8)
 END AS r FROM (SELECT *, CASE WHEN sex = 'BUILDING' THEN 1 ELSE value END AS v FROM cells) GROUP BY ALL""")
def guarded_correlation(spark, folder):
    v = F.when(F.col("sex") == "BUILDING", 1.0).otherwise(F.col("value"))
    cells = b.cells_b(spark, folder).withColumn("v", v)
    return b.rounded(cells.groupBy("batch", "sex").agg(pearson("age", "v").alias("r")), 8)


@query("linear_regression", f"""WITH {SAMPLES_SQL}, s AS (SELECT cell_type, count(*) AS n, regr_sxx(score, age) AS sxx,
 regr_syy(score, age) AS syy, regr_sxy(score, age) AS sxy, avg(age) AS mx, avg(score) AS my FROM samples GROUP BY 1)
 SELECT cell_type, n, round(sxy / sxx, 6) AS slope, round(my - sxy / sxx * mx, 5) AS intercept, round(sxy * sxy / (sxx * syy), 8)
 AS r_squared, round(sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx)), 6) AS slope_se,
 round(sxy / sxx / sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx)), 5) AS t_value FROM s""")
def linear_regression(spark, folder):
    out = linear_fit(samples(spark, folder), ["cell_type"], "age", "score")
    return out.select("cell_type", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"),
                      F.round("r_squared", 8).alias("r_squared"), F.round("slope_se", 6).alias("slope_se"),
                      F.round("t_value", 5).alias("t_value"))


@query("linear_regression_pvalues")
def linear_regression_pvalues(spark, folder):
    out = linear_fit(samples(spark, folder), ["cell_type", "sex"], "age", "score")
    return out.withColumn("pvalue", t_two_sided("t_value", F.col("n") - 2))


@query("nuisance_gramian", f"""WITH {SAMPLES_SQL}, d AS (SELECT cell_type, 1.0::DOUBLE AS x0, (batch = 'AMERICA')::INTEGER AS x1,
 (batch = 'ASIA')::INTEGER AS x2, (batch = 'EUROPE')::INTEGER AS x3, (batch = 'MIDDLE EAST')::INTEGER AS x4, age AS x5 FROM
 samples) SELECT cell_type, count(*) AS n, sum(x0 * x1)::DOUBLE AS g_0_1, sum(x1 * x1)::DOUBLE AS g_1_1, sum(x1 * x2)::DOUBLE AS
 g_1_2, sum(x4)::DOUBLE AS g_4_4, round(sum(x3 * x5), 4) AS g_3_5, round(sum(x5 * x5), 4) AS g_5_5 FROM d GROUP BY 1""")
def nuisance_gramian(spark, folder):
    d, x, _ = indicator_columns(samples(spark, folder), ["batch", "age"])
    g = gramian(d, ["cell_type"], x)
    at = {pq: i for i, pq in enumerate(pairs(len(x)))}
    return b.rounded(g.select("cell_type", "n", *[
        F.col("gram")[at[p, q]].alias(f"g_{p}_{q}") for p, q in ((0, 1), (1, 1), (1, 2), (4, 4), (3, 5), (5, 5))]), 4)


PLANTED = """q AS (SELECT cell_type, CASE cell_type WHEN 'O' THEN 'ONE' ELSE sex END AS sex, CASE WHEN cell_type = 'P' THEN sex WHEN cell_type = 'F' AND
 age > 60 THEN NULL ELSE batch END AS batch, CASE WHEN cell_type = 'F' AND age < 22 THEN 'infinity'::DOUBLE ELSE age END AS age FROM samples)"""


@query("design_problems", f"""WITH {SAMPLES_SQL}, {PLANTED}, s AS (SELECT cell_type, count(*) AS n, count(*) FILTER (batch IS NULL) AS nb, count(*) FILTER (isinf(age)) AS
 na, count(DISTINCT sex) AS ks FROM q GROUP BY 1), f AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY batch) AS turn, sum(k) OVER (PARTITION BY
 cell_type)::BIGINT AS n FROM (SELECT cell_type, batch, count(*) AS k FROM q WHERE batch IS NOT NULL AND NOT isinf(age) GROUP BY ALL)) SELECT cell_type, 'missing' AS
 problem, 'batch' AS "column", nb AS n_rows FROM s WHERE nb > 0 UNION ALL SELECT cell_type, 'not_finite', 'age', na FROM s WHERE na > 0 UNION ALL SELECT cell_type,
 'no_variation', 'sex', n FROM s WHERE ks = 1 UNION ALL SELECT cell_type, 'dependent', 'batch=' || batch, n FROM f WHERE cell_type = 'P' AND turn > 1""")
def design_problems_planted(spark, folder):
    """Covariates with gaps and infinities in type F, without variation in O, and one that repeats another in P."""
    kind, age = F.col("cell_type"), F.col("age")
    rows = samples(spark, folder).withColumns({
        "sex": F.when(kind == "O", "ONE").otherwise(F.col("sex")),
        "batch": F.when(kind == "P", F.col("sex")).when((kind == "F") & (age > 60), None).otherwise(F.col("batch")),
        "age": F.when((kind == "F") & (age < 22), float("inf")).otherwise(age)})
    return design_problems(rows, ["cell_type"], ["sex", "batch", "age"])


@query("one_factor_residuals", f"""WITH {SAMPLES_SQL} SELECT sample_unit_id, cell_type, round(score - avg(score) OVER w, 6) AS
 score_resid, round(age - avg(age) OVER w, 6) AS age_resid FROM samples WINDOW w AS (PARTITION BY cell_type, sex)""")
def one_factor_residuals(spark, folder):
    out = demean(samples(spark, folder), ["cell_type"], "sex", ["score", "age"])
    return b.rounded(out.select("sample_unit_id", "cell_type", "score_resid", "age_resid"))


@query("many_factor_residuals", f"""WITH {SAMPLES_SQL} SELECT cell_type, sex, count(*) AS n, 0.0::DOUBLE AS sum_score_resid,
 0.0::DOUBLE AS sum_age_resid FROM samples GROUP BY ALL""")
def many_factor_residuals(spark, folder):
    """Residuals on sex and batch together; their sums per level must vanish."""
    d, x, _ = indicator_columns(samples(spark, folder), ["sex", "batch"])
    res = residualise(d, ["cell_type"], ["score", "age"], x)
    flat = F.lit(0.0)
    return res.groupBy("cell_type", "sex").agg(
        F.count(F.lit(1)).alias("n"), (F.round(F.sum("score_resid"), 4) + flat).alias("sum_score_resid"),
        (F.round(F.sum("age_resid"), 4) + flat).alias("sum_age_resid"))


@query("degenerate_residuals", f"""WITH {b.CELLS_A}, y AS (SELECT cell_type, sex, CASE WHEN ascii(cell_type) % 2 = 1 THEN (CASE sex WHEN 'F' THEN 1.5 ELSE
 2.5 END) ELSE value END AS y, value FROM cells), r AS (SELECT cell_type, y - avg(y) OVER w AS y_resid, value - avg(value) OVER w AS value_resid FROM y WINDOW w AS
 (PARTITION BY cell_type, sex)) SELECT cell_type, 'y_resid' AS variable FROM r GROUP BY 1 HAVING stddev_pop(y_resid) < 1e-8 UNION ALL SELECT cell_type,
 'value_resid' FROM r GROUP BY 1 HAVING stddev_pop(value_resid) < 1e-8""")
def degenerate_residuals(spark, folder):
    """Tests whose score, flat within each sex in some types, has nothing left after sex is taken out."""
    rows = b.cells_a(spark, folder).withColumn("y", F.when(
        F.ascii("cell_type") % 2 == 1, F.when(F.col("sex") == "F", 1.5).otherwise(2.5)).otherwise(F.col("value")))
    out = demean(rows, ["cell_type"], "sex", ["y", "value"])
    return residual_violations(out, ["cell_type"], ["y_resid", "value_resid"]).select("cell_type", "variable")


@query("design_diagnostics", f"""WITH {SAMPLES_SQL}, m AS (SELECT *, avg(age) OVER (PARTITION BY cell_type, sex) AS mg,
 avg(age) OVER (PARTITION BY cell_type) AS ma FROM samples) SELECT cell_type, count(*) AS n_rows, (count(DISTINCT sex) + 1)
 ::INTEGER AS design_columns, (count(DISTINCT sex) + 1)::INTEGER AS design_rank, (count(*) - count(DISTINCT sex) - 1)::INTEGER AS
 residual_df, round(sum((mg - ma) * (mg - ma)) / sum((age - ma) * (age - ma)), 7) AS age_r2, true AS estimable, '' AS warnings
 FROM m GROUP BY 1""")
def design_diagnostics_one_factor(spark, folder):
    d, x, groups = indicator_columns(samples(spark, folder), ["sex"])
    out = design_diagnostics(age_terms(d, ["cell_type"]), ["cell_type"], x, groups, "age_decade")
    return b.rounded(out.drop("condition_number"), 7)


@query("design_diagnostics_full")
def design_diagnostics_full(spark, folder):
    """Sex within one batch level only, so that rank deficiency shows up in some tests."""
    rows = samples(spark, folder).withColumn(
        "sex", F.when(F.col("cell_type") == "P", F.col("batch")).otherwise(F.col("sex")))
    d, x, groups = indicator_columns(rows, ["sex", "batch"])
    return design_diagnostics(age_terms(d, ["cell_type"]), ["cell_type"], x, groups, "age_decade")


GEE_SQL = """dm AS (SELECT *, (age - avg(age) OVER (PARTITION BY cell_type)) / 10 AS x FROM rows_),
 t AS (SELECT cell_type, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM dm GROUP BY 1),
 c AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM t), e AS (SELECT cell_type, cl, sum((y - (sy - b1 * sx) / n -
 b1 * x) * (n * x - sx) / (n * sxx - sx * sx)) AS u FROM dm JOIN c USING (cell_type) GROUP BY ALL)
 SELECT cell_type, any_value(n) AS n_observations, count(*) AS n_subjects, round(any_value(b1), 6) AS effect_per_10y,
 round(sqrt(sum(u * u)), 6) AS standard_error FROM e JOIN c USING (cell_type) GROUP BY 1"""


@query("gee_gaussian_independence", f"WITH {SAMPLES_SQL}, rows_ AS (SELECT *, score AS y, subject_id AS cl FROM samples), {GEE_SQL}")
def gee_gaussian_independence(spark, folder):
    out = subject_gee(samples(spark, folder), ["cell_type"], "score", [], family="gaussian", weight=None,
                      correlation="independence")
    return b.rounded(out.select("cell_type", "n_observations", "n_subjects", "effect_per_10y", "standard_error"))


@query("gee_gaussian_closed_form", f"WITH {SAMPLES_SQL}, rows_ AS (SELECT *, score AS y, subject_id AS cl FROM samples), {GEE_SQL}")
def gee_gaussian_closed_form(spark, folder):
    out = clustered_age_effect(samples(spark, folder), ["cell_type"], "subject_id", "score")
    return b.rounded(out.select("cell_type", "n_observations", "n_subjects", "effect_per_10y", "standard_error"))


@query("glm_hc0_one_sample_per_subject", f"""WITH {SAMPLES_SQL}, pick AS (SELECT sample_unit_id FROM (SELECT DISTINCT subject_id,
 sample_unit_id, age FROM samples) QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY age, sample_unit_id) = 1),
 rows_ AS (SELECT *, score AS y, sample_unit_id AS cl FROM samples SEMI JOIN pick USING (sample_unit_id)), {GEE_SQL}""")
def glm_hc0_one_sample_per_subject(spark, folder):
    rows = samples(spark, folder)
    single = rows.join(earliest_samples(rows, "subject_id", "sample_unit_id", "age"), "sample_unit_id", "left_semi")
    out = independent_glm(single, ["cell_type"], "score", [], family="gaussian", weight=None)
    return b.rounded(out.select("cell_type", "n_observations", "n_subjects", "effect_per_10y", "standard_error"))


@query("gee_gaussian_exchangeable_adjusted")
def gee_gaussian_exchangeable_adjusted(spark, folder):
    return gee_with_fallback(samples(spark, folder), ["cell_type"], "score", ["sex", "batch"], family="gaussian")


@query("gee_binomial_exchangeable")
def gee_binomial_exchangeable(spark, folder):
    return subject_gee(fractions(spark, folder), ["cell_type"], "fraction", [], family="binomial",
                       weight="total_cells")


@query("composition_associations")
def composition_associations(spark, folder):
    f = sample_fractions(b.cells_a(spark, folder), covariates=["sex"], min_cells=MIN_CELLS)
    return associations(f.withColumn("detected", F.col("n_cells") > 0), ["cell_type"], "fraction", family="binomial",
                        covariates=["sex"], min_subjects=8, detected="detected", weight="total_cells", n_boot=2_000, seed=7)


def signature_rows(spark, folder):
    """Gene-set scores per cell rolled to sample x type x set, dealt by subject."""
    from cohortroll.plans.q_rollups import gene_sets

    cells = b.cells_b(spark, folder).select("cell_id", "sample_unit_id", "cell_type", "subject_id", "age", "sex", "batch")
    return signature_means(cells, b.table(spark, folder, "orders").count(), b.counts_b(spark, folder), b.genes_b(spark, folder),
                           gene_sets(spark, folder), ["subject_id", "sample_unit_id", "cell_type"], ["age", "sex", "batch"])


@query("signature_associations")
def signature_associations(spark, folder):
    rows = signature_rows(spark, folder)
    return associations(rows, ["cell_type", "signature"], "score", family="gaussian", covariates=["sex"],
                        min_subjects=12, min_age_span=12, n_boot=2_000, seed=3, lie_by_subject=True)
