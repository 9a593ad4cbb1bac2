"""Scenario runs, evidence, screening and queues over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortroll.functions.scalar import scenario_code, scenario_name, text_to_bool
from cohortroll.operators import review as rv
from cohortroll.operators.joins import apply_dispositions, disposition_violations
from cohortroll.operators.rollup import sample_fractions
from cohortroll.plans import bindings as b
from cohortroll.plans.q_models import FRACTIONS_SQL, MIN_CELLS, SAMPLES_SQL, samples
from cohortroll.plans.registry import query
from cohortroll.session import keep, scratch_path
from cohortroll.sources.readers import read_scenarios

GRID = rv.scenario_grid({"adjust": True, "drop_sparse": True, "min_cells": 8},
                        {"adjust": [True, False], "drop_sparse": [True, False], "min_cells": [5, 8, 12]})
EDGES = (20, 30, 40, 50, 60)

SCORE_GRID = rv.scenario_grid({"adjust": True, "drop_sparse": True, "min_cells": 2},
                              {"adjust": [True, False], "drop_sparse": [True, False], "min_cells": [1, 2, 3]})


def grid_sql(grid):
    return "grid AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {str(g['adjust']).lower()}, {str(g['drop_sparse']).lower()}, {g['min_cells']})"
        for i, g in enumerate(grid)) + ") t(scenario_order, adjust, drop_sparse, min_cells))"


GRID_SQL = grid_sql(GRID)


@query("scenario_trends", f"""WITH {FRACTIONS_SQL}, sx AS (SELECT sample_unit_id, min(sex) AS sex FROM cells GROUP BY 1), {GRID_SQL},
 r AS (SELECT f.*, sex, g.*, CASE {" ".join(f"WHEN age >= {a} AND age < {z} THEN '{a}-{z}'" for a, z in zip(EDGES, EDGES[1:]))} ELSE
 'outside' END AS age_bin FROM fractions f JOIN sx USING (sample_unit_id) CROSS JOIN grid g WHERE total_cells >= min_cells),
 n AS (SELECT scenario_order, age_bin, count(DISTINCT sample_unit_id) AS nb FROM r GROUP BY ALL), k AS (SELECT r.* FROM r JOIN n USING
 (scenario_order, age_bin) WHERE NOT drop_sparse OR nb >= 100), v AS (SELECT *, CASE WHEN adjust THEN age - avg(age) OVER w ELSE age END
 AS x, CASE WHEN adjust THEN fraction - avg(fraction) OVER w ELSE fraction END AS y FROM k WINDOW w AS (PARTITION BY scenario_order,
 cell_type, sex))
 SELECT printf('adj_%d__drop_sparse_%d__min_cells_%d', adjust::INTEGER, drop_sparse::INTEGER, min_cells) AS scenario,
 printf('A%d|D%d|M%d', adjust::INTEGER, drop_sparse::INTEGER, min_cells) AS code, scenario_order, cell_type, count(*) AS n,
 round(regr_slope(y, x) * 10, 7) AS effect_per_10y, round(regr_r2(y, x), 7) AS r_squared FROM v
 GROUP BY adjust, drop_sparse, min_cells, scenario_order, cell_type""")
def scenario_trends(spark, folder):
    f = keep(sample_fractions(b.cells_a(spark, folder), covariates=["sex"], min_cells=MIN_CELLS), "fractions")
    out = rv.scenario_trends(f, GRID, EDGES, "sex", 100)
    return b.rounded(out.drop("t_value"), 7)


SCORE_ROWS_SQL = f"""{SAMPLES_SQL}, {grid_sql(SCORE_GRID)}, r AS (SELECT f.*, g.*, CASE
 {" ".join(f"WHEN age >= {a} AND age < {z} THEN '{a}-{z}'" for a, z in zip(EDGES, EDGES[1:]))} ELSE 'outside' END AS age_bin
 FROM samples f CROSS JOIN grid g WHERE n_cells >= min_cells), n AS (SELECT scenario_order, age_bin, count(DISTINCT sample_unit_id)
 AS nb FROM r GROUP BY ALL), k AS (SELECT r.* FROM r JOIN n USING (scenario_order, age_bin) WHERE NOT drop_sparse OR nb >= 100),
 v AS (SELECT *, CASE WHEN adjust THEN age - avg(age) OVER w ELSE age END AS x, CASE WHEN adjust THEN score - avg(score) OVER w ELSE
 score END AS y FROM k WINDOW w AS (PARTITION BY scenario_order, cell_type, sex))"""
SCENARIO_SQL = """printf('adj_%d__drop_sparse_%d__min_cells_%d', adjust::INTEGER, drop_sparse::INTEGER, min_cells) AS scenario,
 printf('A%d|D%d|M%d', adjust::INTEGER, drop_sparse::INTEGER, min_cells) AS code, scenario_order, cell_type"""


@query("scenario_score_trends", f"""WITH {SCORE_ROWS_SQL} SELECT {SCENARIO_SQL}, count(*) AS n, round(regr_slope(y, x) * 10, 6) AS effect_per_10y,
 round(regr_r2(y, x), 6) AS r_squared FROM v GROUP BY adjust, drop_sparse, min_cells, scenario_order, cell_type""")
def scenario_score_trends(spark, folder):
    out = rv.scenario_trends(samples(spark, folder), SCORE_GRID, EDGES, "sex", 100, value="score", size="n_cells")
    return b.rounded(out.drop("t_value"), 6)


@query("scenario_clustered_effects", f"""WITH {SCORE_ROWS_SQL}, dm AS (SELECT *, (x - avg(x) OVER (PARTITION BY scenario_order, cell_type)) / 10 AS d FROM v),
 t AS (SELECT scenario_order, cell_type, count(*) AS n, sum(d) AS sx, sum(d * d) AS sxx, sum(y) AS sy, sum(d * y) AS sxy FROM dm GROUP BY ALL),
 c AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM t), e AS (SELECT scenario_order, cell_type, adjust, drop_sparse,
 min_cells, subject_id, sum((y - (sy - b1 * sx) / n - b1 * d) * (n * d - sx) / (n * sxx - sx * sx)) AS u FROM dm JOIN c USING
 (scenario_order, cell_type) GROUP BY ALL)
 SELECT {SCENARIO_SQL}, any_value(n) AS n_observations, count(*) AS n_subjects, round(any_value(b1), 6) AS effect_per_10y,
 round(sqrt(sum(u * u)), 6) AS standard_error FROM e JOIN c USING (scenario_order, cell_type)
 GROUP BY adjust, drop_sparse, min_cells, scenario_order, cell_type""")
def scenario_clustered_effects(spark, folder):
    out = rv.scenario_clustered_effects(samples(spark, folder), SCORE_GRID, EDGES, "sex", 100, ["cell_type"], "score", "n_cells")
    return b.rounded(out.select(*rv.SCENARIO, "cell_type", "n_observations", "n_subjects", "effect_per_10y", "standard_error"))


@query("scenario_labels", """SELECT event_id, printf('adj_%d__drop_sparse_%d__min_cells_%d', event_id % 2, (lower(event_type) = 'view')
 ::INTEGER, user_id) AS name, printf('A%d|D%d|M%d', event_id % 2, (lower(event_type) = 'view')::INTEGER, user_id) AS code FROM events""")
def scenario_labels(spark, folder):
    e = b.table(spark, folder, "events")
    args = [F.col("event_id") % 2 == 1, text_to_bool(F.upper("event_type"), ["view"]), F.col("user_id")]
    return e.select("event_id", scenario_name(*args).alias("name"), scenario_code(*args).alias("code"))


# Four scenarios by supplier; one type lacks one scenario.
SENS_SQL = """base AS (SELECT l_partkey AS gene_id, l_returnflag AS cell_type, CASE l_suppkey % 4 WHEN 0 THEN 'high_cell_support' WHEN 1
 THEN 'drop_sex' WHEN 2 THEN 'drop_batch' ELSE 'lobo_A' END AS scenario_id, CASE l_suppkey % 4 WHEN 0 THEN 'cell_support' WHEN 3 THEN
 'leave_one_batch_out' ELSE 'covariate' END AS scenario_type, l_discount * 100 AS d, l_tax * 100 AS t FROM lineitem),
 prim AS (SELECT gene_id, cell_type, round(avg(d) - 5, 6) AS effect, round(avg(t) * 0.012, 6) AS fdr, count(*) AS n_replicates,
 round(avg(d) - 5 - 0.4, 6) AS ci_low, round(avg(d) - 5 + 0.4, 6) AS ci_high FROM base GROUP BY ALL),
 sens AS (SELECT gene_id, cell_type, scenario_id, scenario_type, round(avg(d) - 5, 6) AS effect, round(avg(t) * 0.012, 6) AS fdr,
 count(*) AS n_replicates FROM base WHERE NOT (cell_type = 'N' AND scenario_id = 'drop_sex') GROUP BY ALL)"""


def evidence_inputs(spark, folder):
    """Primary and per-scenario results per part and return flag."""
    k = F.col("l_suppkey") % 4
    base = b.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("gene_id"), F.col("l_returnflag").alias("cell_type"),
        F.when(k == 0, "high_cell_support").when(k == 1, "drop_sex").when(k == 2, "drop_batch").otherwise("lobo_A")
        .alias("scenario_id"),
        F.when(k == 0, "cell_support").when(k == 3, rv.LEAVE_OUT).otherwise("covariate").alias("scenario_type"),
        (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"))
    mean = F.avg("d") - 5
    values = [F.round(mean, 6).alias("effect"), F.round(F.avg("t") * 0.012, 6).alias("fdr"),
              F.count(F.lit(1)).alias("n_replicates")]
    primary = base.groupBy("gene_id", "cell_type").agg(
        *values, F.round(mean - 0.4, 6).alias("ci_low"), F.round(mean + 0.4, 6).alias("ci_high"))
    sens = base.where("not (cell_type = 'N' and scenario_id = 'drop_sex')").groupBy(
        "gene_id", "cell_type", "scenario_id", "scenario_type").agg(*values)
    return primary, sens


def grouped_inputs(spark, folder):
    """The same with the grouping that each result names; some name a wrong one."""
    primary, sens = evidence_inputs(spark, folder)
    gene = F.col("gene_id")
    return (primary.withColumn("grouping_id_column", F.when(gene % 17 == 0, "cell_id").otherwise("sample_unit_id")),
            sens.withColumn("grouping_id_column", F.when((gene % 19 == 0) & (F.col("scenario_id") == "drop_batch"), "subject_id")
                            .otherwise("sample_unit_id")))


SUMMARY_SQL = """j AS (SELECT p.gene_id, p.cell_type, sign(p.effect) AS ps, s.effect AS se, s.fdr AS sf, s.n_replicates AS sn,
 s.scenario_id FROM prim p LEFT JOIN sens s USING (gene_id, cell_type)), summ AS (SELECT gene_id, cell_type, count(scenario_id) AS
 sensitivity_tested_scenarios, count(*) FILTER (se <> 0 AND ps <> 0) AS cmp, count(*) FILTER (se <> 0 AND ps <> 0 AND sign(se) = ps)
 AS same, count(*) FILTER (sf < 0.05) AS sensitivity_fdr_supported_count, min(se) AS sensitivity_effect_min, max(se) AS
 sensitivity_effect_max, coalesce(min(sn), 0)::BIGINT AS sensitivity_min_replicates, count(*) FILTER (gene_id % 19 = 0 AND scenario_id =
 'drop_batch') = 0 AS sensitivity_grouping_valid FROM j GROUP BY ALL)"""


@query("sensitivity_summary", f"""WITH {SENS_SQL}, {SUMMARY_SQL} SELECT gene_id, cell_type, sensitivity_tested_scenarios,
 sensitivity_fdr_supported_count, sensitivity_effect_min, sensitivity_effect_max, sensitivity_min_replicates, round(coalesce(same /
 nullif(cmp, 0), 0), 6) AS sensitivity_direction_consistency_fraction, round(sensitivity_fdr_supported_count / 4, 6) AS
 sensitivity_fdr_supported_fraction, sensitivity_tested_scenarios = 4 AS sensitivity_complete_pass, sensitivity_tested_scenarios = 4 AND
 same = cmp AS direction_consistency_pass, sensitivity_fdr_supported_count = 4 AS all_sensitivity_fdr_pass, sensitivity_grouping_valid FROM summ""")
def sensitivity_summary(spark, folder):
    primary, sens = grouped_inputs(spark, folder)
    return b.rounded(rv.sensitivity_summary(primary, sens, 4, 0.05))


LOOSE = {**rv.STRICT, "require_fdr_support_all_scenarios": False, "require_direction_consistency": False}

SCREEN_SQL = f"""{SENS_SQL}, {SUMMARY_SQL}, screen AS (SELECT 'expression::' || cell_type || '::' || gene_id AS signal_id, gene_id,
 cell_type, CASE WHEN NOT (fdr < 0.05 AND n_replicates >= 8 AND (ci_low > 0 OR ci_high < 0) AND gene_id % 17 <> 0) THEN 'not_prioritized'
 WHEN sensitivity_tested_scenarios = 4 AND sensitivity_grouping_valid THEN 'candidate_for_human_review' ELSE 'exploratory_sensitivity_limited' END AS
 automated_screen_status FROM prim JOIN summ USING (gene_id, cell_type))"""


def screen(spark, folder):
    primary, sens = grouped_inputs(spark, folder)
    return rv.screen_associations(primary, sens, analysis="expression", expected=4, min_replicates=8, criteria=LOOSE)


@query("association_screen", f"""WITH {SCREEN_SQL} SELECT signal_id, automated_screen_status, 'pending' AS human_disposition, false AS
 public_claim_approved FROM screen""")
def association_screen(spark, folder):
    return screen(spark, folder).select("signal_id", "automated_screen_status", "human_disposition", "public_claim_approved")


DECISIONS_SQL = """dec AS (SELECT signal_id, CASE WHEN gene_id % 3 = 0 THEN 'retain' ELSE 'drop' END AS decision, gene_id % 2 = 0 AS approve
 FROM screen WHERE gene_id % 5 < 2 AND automated_screen_status <> 'not_prioritized')"""


def decisions(evidence):
    g = F.col("gene_id")
    return evidence.where((g % 5 < 2) & (F.col("automated_screen_status") != "not_prioritized")).select(
        "signal_id", F.when(g % 3 == 0, "retain").otherwise("drop").alias("decision"), (g % 2 == 0).alias("approve"))


@query("human_dispositions", f"""WITH {SCREEN_SQL}, {DECISIONS_SQL} SELECT signal_id, coalesce(decision, 'pending') AS human_disposition,
 coalesce(approve AND decision = 'retain', false) AS public_claim_approved FROM screen LEFT JOIN dec USING (signal_id)""")
def human_dispositions(spark, folder):
    ev = screen(spark, folder)
    return apply_dispositions(ev, decisions(ev)).select("signal_id", "human_disposition", "public_claim_approved")


@query("human_disposition_violations", f"""WITH {SCREEN_SQL}, {DECISIONS_SQL} SELECT signal_id, CASE WHEN automated_screen_status <>
 'candidate_for_human_review' THEN 'no_candidate' ELSE 'approved_but_not_retained' END AS problem FROM dec JOIN screen USING (signal_id)
 WHERE automated_screen_status <> 'candidate_for_human_review' OR (approve AND decision <> 'retain')""")
def human_disposition_violations(spark, folder):
    ev = screen(spark, folder)
    return disposition_violations(ev, decisions(ev))


@query("evidence_counts", f"""WITH {SCREEN_SQL}, {DECISIONS_SQL} SELECT automated_screen_status, coalesce(decision, 'pending') AS
 human_disposition, count(*) AS n_signals, count(*) FILTER (approve AND decision = 'retain') AS n_approved FROM screen LEFT JOIN dec
 USING (signal_id) GROUP BY ALL""")
def evidence_counts(spark, folder):
    ev = screen(spark, folder)
    return rv.evidence_counts(apply_dispositions(ev, decisions(ev)))


@query("evidence_id_lists", f"""WITH {SCREEN_SQL}, n AS (SELECT automated_screen_status, signal_id, (row_number() OVER (PARTITION BY automated_screen_status ORDER BY
 signal_id) - 1) // 20 AS list_no FROM screen) SELECT automated_screen_status, list_no::BIGINT AS list_no, count(*) AS n_ids, string_agg(signal_id, ',' ORDER BY
 signal_id) AS signal_ids FROM n GROUP BY ALL""")
def evidence_id_lists(spark, folder):
    """The signals of each screen status, in lists of twenty."""
    return rv.evidence_id_lists(screen(spark, folder), 20).withColumn("signal_ids", F.concat_ws(",", "signal_ids"))


DIAG_SQL = """cand AS (SELECT *, fdr AS fdr_global, CASE WHEN cell_type = 'A' THEN 'primary' ELSE 'exploratory' END AS analysis_tier FROM
 prim WHERE fdr < 0.05), csens AS (SELECT s.*, analysis_tier FROM sens s JOIN cand USING (gene_id, cell_type)),
 diag AS (SELECT t.cell_type, x.scenario_id, x.scenario_type, CASE WHEN t.cell_type = 'N' AND x.scenario_id = 'drop_sex' THEN
 'not_estimable' ELSE 'completed' END AS status FROM (SELECT DISTINCT cell_type FROM cand) t, (SELECT DISTINCT scenario_id, scenario_type
 FROM base) x)"""


def candidate_inputs(spark, folder):
    primary, sens = evidence_inputs(spark, folder)
    primary = primary.withColumn("fdr_global", F.col("fdr")).withColumn(
        "analysis_tier", F.when(F.col("cell_type") == "A", "primary").otherwise("exploratory"))
    cand = primary.where("fdr_global < 0.05").select("gene_id", "cell_type", "analysis_tier")
    sens = keep(sens.join(cand, ["gene_id", "cell_type"]), "sensitivity")
    seen = sens.groupBy("cell_type", "scenario_id", "scenario_type").agg(
        F.count(F.lit(1)).alias("n_candidates_observed"), F.lit("completed").alias("status"))
    absent = cand.where("cell_type = 'N'").select("cell_type").distinct().select(
        "cell_type", F.lit("drop_sex").alias("scenario_id"), F.lit("covariate").alias("scenario_type"),
        F.lit(0).cast("bigint").alias("n_candidates_observed"), F.lit("not_estimable").alias("status"))
    expected = cand.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_candidates_expected"))
    return keep(primary, "primary"), sens, keep(seen.unionByName(absent).join(expected, "cell_type"), "diagnostics")


@query("sensitivity_contract", f"""WITH {SENS_SQL}, {DIAG_SQL}, cp AS (SELECT gene_id, cell_type, analysis_tier FROM cand UNION ALL SELECT gene_id, cell_type,
 analysis_tier FROM cand WHERE gene_id % 50 = 0), sp AS (SELECT CASE WHEN gene_id % 10 = 3 THEN -gene_id ELSE gene_id END AS gene_id, cell_type, scenario_id, CASE
 WHEN gene_id % 7 = 0 THEN 'other' ELSE analysis_tier END AS tier FROM csens), j AS (SELECT tier, cp.analysis_tier AS want FROM sp LEFT JOIN cp USING (gene_id,
 cell_type)), d AS (SELECT cell_type, scenario_id, obs - (cell_type = 'R')::INTEGER AS obs, ex + (scenario_id = 'drop_batch')::INTEGER AS ex, CASE WHEN scenario_id
 = 'lobo_A' THEN 'failed' ELSE status END AS status FROM (SELECT cell_type, scenario_id, count(*) AS obs, 'completed' AS status FROM csens GROUP BY ALL UNION ALL
 SELECT DISTINCT cell_type, 'drop_sex', 0, 'not_estimable' FROM cand WHERE cell_type = 'N') JOIN (SELECT cell_type, count(*) AS ex FROM cand GROUP BY 1) USING
 (cell_type)), w AS (SELECT d.*, coalesce(ne, 0) AS ne, coalesce(ns, 0) AS ns FROM d LEFT JOIN (SELECT cell_type, count(*) AS ne FROM cp GROUP BY 1) USING
 (cell_type) LEFT JOIN (SELECT cell_type, scenario_id, count(*) AS ns FROM sp GROUP BY ALL) USING (cell_type, scenario_id))
 SELECT 'non_candidate_rows' AS problem, count(*) FILTER (want IS NULL) AS n FROM j UNION ALL SELECT 'tier_mismatches', count(*) FILTER (tier <> want) FROM j
 UNION ALL SELECT 'wrong_denominators', count(*) FILTER (ex <> ne) FROM w UNION ALL SELECT 'wrong_observed_counts', count(*) FILTER (obs <> ns) FROM w UNION ALL
 SELECT 'rows_without_fit', count(*) FILTER (status <> 'completed' AND ns > 0) FROM w UNION ALL SELECT 'duplicate_candidates', count(*) FROM (SELECT 1 FROM cp
 GROUP BY gene_id, cell_type HAVING count(*) > 1)""")
def sensitivity_contract(spark, folder):
    """Each kind of violation is planted: strangers, wrong tiers, denominators and counts, a failed fit, repeated candidates."""
    primary, sens, diag = candidate_inputs(spark, folder)
    gene, scenario = F.col("gene_id"), F.col("scenario_id")
    sens = sens.withColumn("analysis_tier", F.when(gene % 7 == 0, "other").otherwise(F.col("analysis_tier"))).withColumn(
        "gene_id", F.when(gene % 10 == 3, -gene).otherwise(gene))
    diag = diag.withColumns({
        "n_candidates_expected": F.col("n_candidates_expected") + (scenario == "drop_batch").cast("int"),
        "n_candidates_observed": F.col("n_candidates_observed") - (F.col("cell_type") == "R").cast("int"),
        "status": F.when(scenario == "lobo_A", "failed").otherwise(F.col("status"))})
    return rv.sensitivity_violations(primary.unionByName(primary.where(gene % 50 == 0)), sens, diag, 0.05)


EVIDENCE_SQL = f"""{SENS_SQL}, {DIAG_SQL}, ev AS (SELECT c.gene_id, c.cell_type, c.analysis_tier, any_value(c.effect) AS effect,
 any_value(c.fdr_global) AS fdr_global, any_value(dn.nc) AS n_completed_scenarios, count(s.scenario_id) AS n_observed_scenarios,
 round(avg((sign(s.effect) = sign(c.effect))::INTEGER) FILTER (s.scenario_id IS NOT NULL), 6) AS direction_concordance_fraction,
 min(s.effect) AS sensitivity_effect_min, max(s.effect) AS sensitivity_effect_max, round(max(abs(s.effect - c.effect)), 6) AS
 max_absolute_effect_change, max(s.effect) FILTER (s.scenario_id = 'drop_sex') AS drop_sex_effect, count(*) FILTER (s.scenario_id =
 'lobo_A') AS n_leave_one_batch_out_observed, CASE WHEN any_value(c.effect) > 0 THEN 'higher_with_age' ELSE 'lower_with_age' END AS
 effect_direction FROM cand c JOIN (SELECT cell_type, count(*) AS nc FROM diag WHERE status = 'completed' GROUP BY 1) dn ON
 dn.cell_type = c.cell_type LEFT JOIN csens s ON s.gene_id = c.gene_id AND s.cell_type = c.cell_type GROUP BY ALL)"""

EVIDENCE_COLUMNS = ["gene_id", "cell_type", "analysis_tier", "effect", "fdr_global", "n_completed_scenarios", "n_observed_scenarios",
                    "direction_concordance_fraction", "sensitivity_effect_min", "sensitivity_effect_max", "max_absolute_effect_change",
                    "drop_sex_effect", "n_leave_one_batch_out_observed", "effect_direction"]


@query("candidate_evidence", f"WITH {EVIDENCE_SQL} SELECT *, n_completed_scenarios - n_observed_scenarios AS "
       "n_missing_after_expression_filter FROM ev")
def candidate_evidence(spark, folder):
    out = rv.candidate_evidence(*candidate_inputs(spark, folder), 0.05)
    return b.rounded(out.select(*EVIDENCE_COLUMNS, "n_missing_after_expression_filter"))


@query("review_queue", f"""WITH {EVIDENCE_SQL} SELECT gene_id, cell_type, effect_direction, row_number() OVER w::INTEGER AS
 review_rank_within_direction FROM ev WINDOW w AS (PARTITION BY cell_type, effect_direction ORDER BY fdr_global,
 max_absolute_effect_change, gene_id) QUALIFY row_number() OVER w <= 10""")
def review_queue(spark, folder):
    ev = rv.candidate_evidence(*candidate_inputs(spark, folder), 0.05).withColumn(
        "max_absolute_effect_change", F.round("max_absolute_effect_change", 6))
    return rv.review_queue(ev, 10).select("gene_id", "cell_type", "effect_direction", "review_rank_within_direction")


@query("type_robustness", f"""WITH {EVIDENCE_SQL}, pf AS (SELECT l_returnflag AS cell_type, l_suppkey, 'B' || (l_suppkey % 3) AS batch, 'S' ||
 (l_suppkey % 2) AS sex, 20 + l_suppkey % 45 AS age, count(*) AS n_cells, sum(l_quantity)::BIGINT AS library_size FROM lineitem GROUP BY
 ALL), rk AS (SELECT *, rank() OVER (PARTITION BY cell_type ORDER BY age) + (count(*) OVER (PARTITION BY cell_type, age) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY cell_type ORDER BY n_cells) + (count(*) OVER (PARTITION BY cell_type, n_cells) - 1) / 2.0 AS rn, rank() OVER
 (PARTITION BY cell_type ORDER BY library_size) + (count(*) OVER (PARTITION BY cell_type, library_size) - 1) / 2.0 AS rl FROM pf)
 SELECT cell_type, count(*) AS n_profiles, count(DISTINCT batch) AS n_batches, count(DISTINCT sex) AS n_sex_levels, min(n_cells) AS
 minimum_cells_per_profile, median(library_size) AS median_library_size, round(corr(ra, rn), 7) AS spearman_age_vs_n_cells,
 round(corr(ra, rl), 7) AS spearman_age_vs_library_size, (SELECT count(*) FROM diag d WHERE d.cell_type = rk.cell_type AND status =
 'not_estimable') AS n_scenarios_not_estimable, (SELECT count(*) FROM ev WHERE ev.cell_type = rk.cell_type) AS n_global_fdr_candidates,
 (SELECT round(median(direction_concordance_fraction), 6) FROM ev WHERE ev.cell_type = rk.cell_type) AS
 median_candidate_direction_concordance FROM rk GROUP BY cell_type""")
def type_robustness(spark, folder):
    primary, sens, diag = candidate_inputs(spark, folder)
    ev = keep(rv.candidate_evidence(primary, sens, diag, 0.05), "evidence")
    k = F.col("l_suppkey")
    pf = keep(b.table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("cell_type"), k).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("l_quantity").cast("bigint").alias("library_size")).withColumns({
            "batch": F.concat(F.lit("B"), k % 3), "sex": F.concat(F.lit("S"), k % 2), "age": 20 + k % 45}), "profiles")
    out = rv.type_robustness(pf, diag, ev, rv.review_queue(ev, 10))
    return out.select(
        "cell_type", "n_profiles", "n_batches", "n_sex_levels", "minimum_cells_per_profile", "median_library_size",
        F.round("spearman_age_vs_n_cells", 7).alias("spearman_age_vs_n_cells"),
        F.round("spearman_age_vs_library_size", 7).alias("spearman_age_vs_library_size"), "n_scenarios_not_estimable",
        "n_global_fdr_candidates", F.round("median_candidate_direction_concordance", 6).alias("median_candidate_direction_concordance"))


@query("scenario_metrics", f"""WITH {SENS_SQL} SELECT scenario_id, count(*) AS n_tests, count(*) FILTER (fdr < 0.05) AS
 n_fdr_significant, round(median(abs(effect)), 6) AS median_abs_effect FROM sens GROUP BY 1""")
def scenario_metrics(spark, folder):
    _, sens = evidence_inputs(spark, folder)
    return b.rounded(rv.scenario_metrics(sens, "scenario_id", "effect", "fdr"))


@query("scenario_tables_read_back", f"""WITH {SENS_SQL} SELECT scenario_id, cell_type, count(*) AS n, round(sum(effect), 3) AS total FROM
 sens GROUP BY ALL""")
def scenario_tables_read_back(spark, folder):
    path = scratch_path(spark, "scenarios")
    _, sens = evidence_inputs(spark, folder)
    sens.write.partitionBy("scenario_id").parquet(path)
    return b.rounded(read_scenarios(spark, path).groupBy("scenario_id", "cell_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("effect").alias("total")), 3)


@query("effect_stability_matrix", f"""WITH {SENS_SQL} SELECT gene_id || '|' || cell_type AS signal_id, {", ".join(
 f"min(effect) FILTER (scenario_id = '{s}') AS {s}" for s in ("high_cell_support", "drop_sex", "drop_batch", "lobo_A"))} FROM sens GROUP BY 1""")
def effect_stability_matrix(spark, folder):
    _, sens = evidence_inputs(spark, folder)
    keyed = sens.withColumn("signal_id", F.concat_ws("|", "gene_id", "cell_type"))
    return rv.stability_matrix(keyed, "signal_id", "scenario_id", "effect",
                               [*rv.REQUIRED_SCENARIOS, "lobo_A"])


@query("scenario_manifest_union", f"""WITH {SENS_SQL} SELECT DISTINCT cell_type, scenario_id, scenario_type FROM sens""")
def scenario_manifest_union(spark, folder):
    _, sens = evidence_inputs(spark, folder)
    m = sens.select("cell_type", "scenario_id", "scenario_type")
    return m.where("scenario_type = 'covariate'").union(m.where("scenario_id <> 'drop_sex'")).distinct()
