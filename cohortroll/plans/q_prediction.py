"""Age prediction from latent vectors and the summaries of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortroll.operators import predict as pr
from cohortroll.operators import tree_models as tm
from cohortroll.operators.review import prediction_screen
from cohortroll.operators.rollup import mean_vectors, pack_vectors
from cohortroll.operators.sampling import grouped_folds
from cohortroll.operators.stats import prediction_metrics
from cohortroll.plans import bindings as b
from cohortroll.plans.q_sampling import FOLDS_SQL, REPLICATES, draws_sql, hash_sql
from cohortroll.plans.registry import query
from cohortroll.session import keep


def profiles(spark, folder):
    """Mean vector per subject, sample and type, with the sample's age."""
    v = b.vectors(spark, folder)
    keys = ["subject_id", "sample_unit_id", "cell_type"]
    packed = pack_vectors(mean_vectors(v, keys, "vec", 1), keys)
    ages = v.groupBy("sample_unit_id").agg(F.min("age").alias("age"))
    return packed.join(ages, "sample_unit_id")


@query("ridge_nested_predictions")
def ridge_nested_predictions(spark, folder):
    out = pr.nested_ridge(profiles(spark, folder), "subject_id")
    return pr.prediction_frame(out).select(
        "model", "subject_id", "sample_unit_id", "cell_type", "n_cells", "outer_fold", "age", "age_pred", "age_base",
        "residual", "abs_error", "within_5y")


@query("ridge_model_table")
def ridge_model_table(spark, folder):
    preds = keep(ridge_nested_predictions(spark, folder), "predictions")
    rolled = pr.roll_to_sample(preds, ["model", "subject_id", "sample_unit_id"])
    return pr.model_table(rolled, "subject_id", REPLICATES, 0.95, 1)


@query("boosted_tree_predictions")
def boosted_tree_predictions(spark, folder):
    return pr.gbt_predictions(profiles(spark, folder), "subject_id", 3, 1, maxIter=3, maxDepth=3)


PREDS_SQL = f"""{FOLDS_SQL}, pb AS (SELECT fold, (sum(sum(m)) OVER () - sum(m)) / (sum(count(*)) OVER () - count(*)) AS age_base FROM
 (SELECT c.subject_id, fold, median(age) AS m FROM cells c JOIN folds USING (subject_id) GROUP BY ALL) GROUP BY fold),
 ag AS (SELECT c.subject_id, sample_unit_id, cell_type, fold AS outer_fold, count(*) AS n_cells, round(min(age), 8) AS age, avg(k) AS k, avg(value) AS v FROM
 cells c JOIN folds USING (subject_id) GROUP BY ALL), raw AS (SELECT m.model, ag.* EXCLUDE (k, v), CASE m.model WHEN 'ridge_a' THEN 30 + k / 5 WHEN 'ridge_b' THEN
 42 + v / 50 ELSE 36 + v / 10 END AS age_pred, round(age_base, 8) AS age_base FROM ag JOIN pb ON pb.fold = ag.outer_fold CROSS JOIN
 (VALUES ('ridge_a'), ('ridge_b'), ('tree')) m(model)), preds AS (SELECT * REPLACE (round(age_pred, 8) AS age_pred) FROM raw)"""


def simple_predictions(spark, folder, digits: int | None = 8):
    """Three plain predictors on the event cells, so every summary below can be checked in SQL."""
    cells = b.cells_a(spark, folder)
    folds = grouped_folds(cells, "subject_id", 5).select("subject_id", F.col("fold").alias("outer_fold"))
    rows = keep(cells.select("subject_id", "sample_unit_id", "cell_type", "age", "k", "value").join(folds, "subject_id"), "rows")
    base = pr.training_baseline(rows, "subject_id")
    agg = rows.groupBy("subject_id", "sample_unit_id", "cell_type", "outer_fold").agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.min("age"), 8).alias("age"), F.avg("k").alias("k"), F.avg("value").alias("v"))
    models = F.array(*[F.struct(F.lit(n).alias("model"), (F.round(e, digits) if digits else e).alias("age_pred")) for n, e in (
        ("ridge_a", 30 + F.col("k") / 5), ("ridge_b", 42 + F.col("v") / 50), ("tree", 36 + F.col("v") / 10))])
    out = agg.select("*", F.inline(models)).join(base.withColumn("age_base", F.round("age_base", 8)), "outer_fold")
    return keep(out.drop("k", "v"), "predictions")


@query("nested_model_predictions")
def nested_model_predictions(spark, folder):
    """Every ridge and tree candidate, and the nested choice among all of them, on rows of held-out subjects."""
    out, _ = tm.nested_models(profiles(spark, folder), "subject_id")
    return pr.prediction_frame(out)


@query("nested_candidate_choice", f"""WITH {PREDS_SQL}, i AS (SELECT p.* EXCLUDE (outer_fold), o.f AS fit_outer FROM preds p, (SELECT DISTINCT outer_fold AS f FROM
 preds) o WHERE o.f <> p.outer_fold), s AS (SELECT fit_outer, model, sample_unit_id, sum(age_pred * n_cells) / sum(n_cells) AS yp, median(age) AS y FROM i GROUP
 BY ALL), e AS (SELECT fit_outer, model, avg(abs(y - yp)) AS mae FROM s GROUP BY ALL) SELECT fit_outer, model, round(mae, 7) AS mae FROM e QUALIFY row_number() OVER
 (PARTITION BY fit_outer ORDER BY round(mae, 12), list_position(['tree', 'ridge_b', 'ridge_a'], model)) = 1""")
def nested_candidate_choice(spark, folder):
    """The candidate of least sample-level error inside each outer fold, of the three plain predictors."""
    preds = simple_predictions(spark, folder)
    folds = preds.agg(F.collect_set("outer_fold").alias("f")).scalar()
    inside = preds.withColumn("fit_outer", F.explode(F.array_except(folds, F.array("outer_fold"))))
    return b.rounded(tm.choose_candidates(inside, ["tree", "ridge_b", "ridge_a"]), 7)


@query("training_baseline", f"""WITH {PREDS_SQL} SELECT fold AS outer_fold, round(age_base, 8) AS age_base FROM pb""")
def training_baseline(spark, folder):
    cells = b.cells_a(spark, folder).select("subject_id", "age")
    folds = grouped_folds(cells, "subject_id", 5).select("subject_id", F.col("fold").alias("outer_fold"))
    return b.rounded(pr.training_baseline(cells.join(folds, "subject_id"), "subject_id"), 8)


@query("prediction_frames", f"""WITH {PREDS_SQL} SELECT model, sample_unit_id, cell_type, round(age_pred - age, 8) AS residual,
 round(abs(age_pred - age), 8) AS abs_error, abs(age_pred - age) <= 5 AS within_5y FROM preds""")
def prediction_frames(spark, folder):
    out = pr.prediction_frame(simple_predictions(spark, folder))
    return b.rounded(out.select("model", "sample_unit_id", "cell_type", "residual", "abs_error", "within_5y"), 8)


@query("prediction_rollup_to_sample", f"""WITH {PREDS_SQL} SELECT model, sample_unit_id, round(sum(age_pred * n_cells) / sum(n_cells), 9) AS age_pred,
 round(sum(age_base * n_cells) / sum(n_cells), 7) AS age_base, sum(n_cells)::BIGINT AS n_cells, count(*) AS n_groups, round(median(age), 7) AS age
 FROM raw GROUP BY ALL""")
def prediction_rollup_to_sample(spark, folder):
    out = pr.roll_to_sample(simple_predictions(spark, folder, digits=None), ["model", "sample_unit_id"])
    return b.rounded(out.withColumn("age", F.round("age", 7)).withColumn("age_base", F.round("age_base", 7)), 9)


METRICS_SQL = """rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY age) + (count(*) OVER (PARTITION BY model, age) - 1) / 2.0 AS ra, rank()
 OVER (PARTITION BY model ORDER BY age_pred) + (count(*) OVER (PARTITION BY model, age_pred) - 1) / 2.0 AS rp FROM preds), met AS (SELECT model,
 count(*) AS n, avg(abs(age - age_pred)) AS mae, sqrt(avg((age - age_pred) ** 2)) AS rmse, 1 - avg((age - age_pred) ** 2) / var_pop(age) AS r2,
 corr(age, age_pred) AS pearson_r, avg((abs(age - age_pred) <= 5)::INTEGER) AS within_5y, avg(abs(age - age_base)) AS baseline_mae,
 avg(abs(age - age_base)) - avg(abs(age - age_pred)) AS mae_gain, median(abs(age - age_pred)) AS median_ae, corr(ra, rp) AS spearman_rho FROM rk
 GROUP BY 1)"""


@query("prediction_metrics", f"""WITH {PREDS_SQL}, {METRICS_SQL} SELECT model, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2,
 round(pearson_r, 6) AS pearson_r, round(within_5y, 6) AS within_5y, round(baseline_mae, 6) AS baseline_mae, round(mae_gain, 6) AS mae_gain,
 round(median_ae, 6) AS median_ae, round(spearman_rho, 6) AS spearman_rho FROM met""")
def metrics(spark, folder):
    return b.rounded(prediction_metrics(simple_predictions(spark, folder), ["model"], "age", "age_pred", "age_base"))


BOOT_SQL = f"""bq AS (SELECT model, subject_id, count(*) AS n, sum(abs(age - age_pred)) AS ae, sum((age - age_pred) ** 2) AS se, sum(age) AS t1,
 sum(age * age) AS t2 FROM preds GROUP BY ALL), nb AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {hash_sql("subject_id")},
 subject_id) - 1 AS i, count(*) OVER (PARTITION BY model) AS m FROM bq), dr AS {draws_sql("nb", "model", 2, "m")}, rp AS (SELECT d.model, d.b, sum(ae) / sum(n) AS mae, 1 - sum(se) / (sum(t2) - sum(t1) * sum(t1) /
 sum(n)) AS r2 FROM dr d JOIN nb ON nb.i = d.i AND nb.model = d.model GROUP BY ALL), ci AS (SELECT model, quantile_cont(mae, 0.025) AS mae_lo,
 quantile_cont(mae, 0.975) AS mae_hi, quantile_cont(r2, 0.025) AS r2_lo, quantile_cont(r2, 0.975) AS r2_hi FROM rp GROUP BY 1)"""


@query("model_table", f"""WITH {PREDS_SQL}, {METRICS_SQL}, {BOOT_SQL} SELECT model, round(mae, 6) AS mae, round(mae_lo, 5) AS mae_ci_low, round(mae_hi, 5)
 AS mae_ci_high, round(r2_lo, 5) AS r2_ci_low, round(r2_hi, 5) AS r2_ci_high, mae = (SELECT min(mae) FROM met) AS is_best_model, model LIKE 'ridge%' AND
 mae = (SELECT min(mae) FROM met WHERE model LIKE 'ridge%') AS is_best_ridge, round(mae - (SELECT min(mae) FROM met WHERE model LIKE 'ridge%'), 6) AS
 delta_vs_best_ridge FROM met JOIN ci USING (model)""")
def model_table(spark, folder):
    m = pr.model_table(simple_predictions(spark, folder), "subject_id", REPLICATES, 0.95, 2)
    return m.select("model", F.round("mae", 6).alias("mae"), *[F.round(c, 5).alias(c) for c in (
        "mae_ci_low", "mae_ci_high", "r2_ci_low", "r2_ci_high")], "is_best_model", "is_best_ridge",
        F.round("delta_vs_best_ridge", 6).alias("delta_vs_best_ridge"))


@query("prediction_screen", f"""WITH {PREDS_SQL}, {METRICS_SQL} SELECT 1::BIGINT AS n_best, model, round(mae, 6) AS mae, round(baseline_mae, 6) AS
 baseline_mae, CASE WHEN mae < baseline_mae AND r2 > 0.5 THEN 'candidate_for_human_review' ELSE 'not_prioritized' END AS automated_screen_status FROM
 met WHERE mae = (SELECT min(mae) FROM met)""")
def screen(spark, folder):
    m = pr.model_table(simple_predictions(spark, folder), "subject_id", REPLICATES, 0.95, 2)
    return b.rounded(prediction_screen(m).drop("r2_ci_low"))


@query("model_comparison", f"""WITH {PREDS_SQL}, f AS (SELECT model, outer_fold, avg(abs(age - age_pred)) AS mae FROM preds GROUP BY ALL), d AS (SELECT
 f.model, f.outer_fold, round(f.mae - r.mae, 9) AS delta FROM f JOIN f r ON r.outer_fold = f.outer_fold AND r.model = 'ridge_b' WHERE f.model <>
 'ridge_b'), nb AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {hash_sql("outer_fold::VARCHAR")}, outer_fold) - 1 AS i, count(*) OVER
 (PARTITION BY model) AS n FROM d), dr AS {draws_sql("nb", "model", 4, "n")}, rp AS (SELECT d.model, d.b, avg(nb.delta) AS m FROM dr d JOIN nb ON nb.model = d.model AND nb.i = d.i GROUP BY ALL), bs AS (SELECT model,
 round(quantile_cont(m, 0.025), 6) AS mean_ci_low, round(quantile_cont(m, 0.975), 6) AS mean_ci_high, round(avg((m > 0)::INTEGER), 6) AS
 share_above_zero FROM rp GROUP BY 1) SELECT model, count(*) AS n_folds, count(*) FILTER (delta < 0) AS n_wins, count(*) FILTER (delta > 0) AS n_losses,
 count(*) FILTER (delta = 0) AS n_ties, round(avg(delta), 6) AS mean_delta, round(median(delta), 6) AS median_delta, any_value(mean_ci_low) AS
 mean_ci_low, any_value(mean_ci_high) AS mean_ci_high, any_value(share_above_zero) AS share_above_zero FROM d JOIN bs USING (model) GROUP BY 1""")
def model_comparison(spark, folder):
    return b.rounded(pr.compare_models(simple_predictions(spark, folder), "ridge_b", REPLICATES, 0.95, 4))
