"""Evidence review: sensitivity scenarios, candidate evidence, screening and queues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortroll.functions.scalar import (
    age_bin, effect_direction, interval_excludes_zero, join_key_text, scenario_code, scenario_name)
from cohortroll.operators.ordering import sorted_position, top_per_group
from cohortroll.operators.rollup import wide_quantiles
from cohortroll.operators.stats import clustered_age_effect, demean, level_means, linear_fit, spearman
from cohortroll.session import dealt, keep

SIGNAL = ("gene_id", "cell_type")
# Fixed value: the column whose rows are the independent replicates of association results.
GROUPING = "sample_unit_id"
REQUIRED_SCENARIOS = ("high_cell_support", "drop_sex", "drop_batch")  # fixed value
LEAVE_OUT = "leave_one_batch_out"


def scenario_grid(baseline: Mapping, options: Mapping[str, Sequence]) -> list[dict]:
    """Baseline first, then one parameter changed at a time; repeats dropped, order kept."""
    grid = [dict(baseline)]
    for name, values in options.items():
        for value in values:
            row = {**baseline, name: value}
            if row not in grid:
                grid.append(row)
    return grid


SCENARIO = ("scenario", "code", "scenario_order")
FIELDS = ("adjust", "drop_sparse", "min_cells")


def _items(grid: Sequence[Mapping]) -> Column:
    def lit(v):
        return F.lit(v) if not isinstance(v, int) or isinstance(v, bool) else F.lit(v).cast("int")

    return F.array(*[F.struct(F.lit(i).alias("scenario_order"), *[lit(v).alias(k) for k, v in s.items()])
                     for i, s in enumerate(grid)])


def with_scenarios(df: DataFrame, grid: Sequence[Mapping]) -> DataFrame:
    """Every row under every scenario, scenario fields as columns; the grid is a short constant."""
    return df.select("*", F.inline(_items(grid)))


def with_names(df: DataFrame, grid: Sequence[Mapping]) -> DataFrame:
    """Name and code of the scenario of each ``scenario_order``; results get them, rows don't carry them."""
    item = F.element_at(_items(grid), F.col("scenario_order") + 1)
    args = [item[c] for c in FIELDS]
    return df.select(scenario_name(*args).alias("scenario"), scenario_code(*args).alias("code"), *df.columns)


def scenario_rows(rows: DataFrame, grid: Sequence[Mapping], edges: Sequence[float], covariate: str, sparse_below: int,
                  keys: Sequence[str], value: str, size: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows that each scenario keeps, with its ``x`` (age) and ``y`` (value) for every test ``scenario_order, keys``.

    A scenario keeps rows whose ``size`` reaches its number of cells, may leave out age bins with few samples, and may
    adjust age and value for one covariate inside each test. Samples per bin and level means are written first, as small
    tables, so the unfolded rows meet them where they are. Large tables are dealt ``by`` columns before they unfold.
    """
    rows = rows.withColumn("age_bin", F.coalesce(age_bin("age", edges), F.lit("outside")))
    largest = rows.where("sample_unit_id is not null").groupBy("age_bin", "sample_unit_id").agg(F.max(size).alias(size))
    support = keep(with_scenarios(largest, grid).where(F.col(size) >= F.col("min_cells")).groupBy("scenario_order", "age_bin").agg(
        F.count(F.lit(1)).alias("n_in_bin")), "bins")

    def kept(some: DataFrame) -> DataFrame:
        unfolded = with_scenarios(some, grid).where(F.col(size) >= F.col("min_cells"))
        return unfolded.join(support, ["scenario_order", "age_bin"]).where(~F.col("drop_sparse") | (F.col("n_in_bin") >= sparse_below))

    tests = ["scenario_order", *keys]
    means = keep(level_means(kept(rows), tests, covariate, ["age", value]), "levels")
    out = demean(kept(dealt(rows, rows.count(), *by) if by else rows), tests, covariate, ["age", value], means)
    return out.withColumns({
        "x": F.when(F.col("adjust"), F.col("age_resid")).otherwise(F.col("age")),
        "y": F.when(F.col("adjust"), F.col(f"{value}_resid")).otherwise(F.col(value))})


def scenario_trends(fractions: DataFrame, grid: Sequence[Mapping], edges: Sequence[float], covariate: str, sparse_below: int,
                    keys: Sequence[str] = ("cell_type",), value: str = "fraction", size: str = "total_cells") -> DataFrame:
    """Age trend of each test under each scenario, all scenarios in one plan."""
    rows = scenario_rows(fractions, grid, edges, covariate, sparse_below, keys, value, size)
    fit = with_names(linear_fit(rows, ["scenario_order", *keys], "x", "y"), grid)
    return fit.select(*SCENARIO, *keys, "n", (F.col("slope") * 10).alias("effect_per_10y"), "r_squared", "t_value")


def scenario_clustered_effects(rows: DataFrame, grid: Sequence[Mapping], edges: Sequence[float], covariate: str,
                               sparse_below: int, keys: Sequence[str], value: str, size: str,
                               subject: str = "subject_id") -> DataFrame:
    """Age effect with subject-clustered errors (working independence) of each test under each scenario, in one plan."""
    kept = scenario_rows(rows, grid, edges, covariate, sparse_below, keys, value, size, [subject])
    tests = ["scenario_order", *keys]
    out = clustered_age_effect(kept.select(*tests, subject, F.col("x").alias("age"), "y"), tests, subject, "y")
    return with_names(out, grid)


def scenario_metrics(results: DataFrame, scenario: str, effect: str, fdr: str) -> DataFrame:
    size = results.withColumn("__a", F.abs(effect))
    base = size.groupBy(scenario).agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if(F.col(fdr) < 0.05).alias("n_fdr_significant"))
    return base.join(wide_quantiles(size, [scenario], "__a", {"median_abs_effect": 0.5}), scenario)


def stability_matrix(results: DataFrame, signal: str, scenario: str, effect: str, names: Sequence[str]):
    """Signals by scenarios; one effect per cell."""
    return results.groupBy(signal).pivot(scenario, list(names)).agg(F.min(effect))


def sensitivity_summary(primary: DataFrame, sensitivity: DataFrame, expected: int, threshold: float,
                        keys: Sequence[str] = SIGNAL, grouping: str = GROUPING) -> DataFrame:
    """How each primary signal fares over the scenarios.

    ``sensitivity_grouping_valid``: every scenario's result counted replicates by the grouping column that
    it names in ``grouping_id_column``; a null name is none. A signal without results has no bad one.
    """
    d = effect_direction("s_effect")
    main = effect_direction("effect")
    j = primary.join(sensitivity.select(
        *keys, "scenario_id", F.col("effect").alias("s_effect"), F.col("fdr").alias("s_fdr"),
        F.col("n_replicates").alias("s_n"), F.col("grouping_id_column").alias("s_grouping")), list(keys), "left")
    tested = F.col("scenario_id").isNotNull()
    comparable = tested & (d != 0) & (main != 0)
    same = comparable & (d == main)
    agg = j.groupBy(*keys).agg(
        F.count_if(tested).alias("sensitivity_tested_scenarios"),
        F.count_if(comparable).alias("__comparable"), F.count_if(same).alias("__same"),
        F.count_if(F.col("s_fdr") < threshold).alias("sensitivity_fdr_supported_count"),
        F.count("s_fdr").alias("__with_fdr"), F.min("s_effect").alias("sensitivity_effect_min"),
        F.max("s_effect").alias("sensitivity_effect_max"),
        F.coalesce(F.min("s_n"), F.lit(0).cast("bigint")).alias("sensitivity_min_replicates"),
        (F.count_if(tested & ~F.col("s_grouping").eqNullSafe(grouping)) == 0).alias("sensitivity_grouping_valid"))
    complete = F.col("sensitivity_tested_scenarios") == expected
    return agg.withColumns({
        "sensitivity_direction_consistency_fraction": F.coalesce(
            F.try_divide(F.col("__same").cast("double"), "__comparable"), F.lit(0.0)),
        "sensitivity_fdr_supported_fraction": F.col("sensitivity_fdr_supported_count") / expected,
        "sensitivity_complete_pass": complete,
        "direction_consistency_pass": complete & (F.col("__same") == F.col("__comparable")),
        "all_sensitivity_fdr_pass": complete & (F.col("__with_fdr") == expected)
        & (F.col("sensitivity_fdr_supported_count") == expected),
    }).drop("__comparable", "__same", "__with_fdr")


def screen_status(criteria: Mapping[str, bool]) -> Column:
    """candidate_for_human_review, exploratory_sensitivity_limited or not_prioritized."""
    def need(flag: str, column: str) -> Column:
        return F.col(column) if criteria[flag] else F.lit(True)

    core = (F.col("corrected_fdr_pass") & F.col("min_support_pass") & F.col("grouping_valid")
            & need("require_effect_ci_excludes_zero", "effect_ci_excludes_zero"))
    steady = (need("require_all_sensitivity_scenarios", "sensitivity_complete_pass")
              & need("require_direction_consistency", "direction_consistency_pass")
              & need("require_fdr_support_all_scenarios", "all_sensitivity_fdr_pass") & F.col("sensitivity_grouping_valid"))
    return F.when(~core, "not_prioritized").when(steady, "candidate_for_human_review").otherwise(
        "exploratory_sensitivity_limited")


STRICT = {"require_effect_ci_excludes_zero": True, "require_all_sensitivity_scenarios": True,
          "require_direction_consistency": True, "require_fdr_support_all_scenarios": True}


def screen_associations(primary: DataFrame, sensitivity: DataFrame, *, analysis: str, expected: int,
                        threshold: float = 0.05, min_replicates: int = 20, criteria=STRICT,
                        keys: Sequence[str] = SIGNAL, grouping: str = GROUPING) -> DataFrame:
    """Evidence row per signal with its automated screen; human decisions start as pending.

    A signal, or a scenario, whose replicates are not the rows of ``grouping`` never passes.
    """
    summary = sensitivity_summary(primary, sensitivity, expected, threshold, keys, grouping)
    rows = primary.join(summary, list(keys)).withColumns({
        "signal_id": join_key_text(F.lit(analysis), *reversed(keys)),
        "corrected_fdr_pass": F.coalesce(F.col("fdr") < threshold, F.lit(False)),
        "min_support_pass": F.col("n_replicates") >= min_replicates,
        "grouping_valid": F.col("grouping_id_column").eqNullSafe(grouping),
        "effect_ci_excludes_zero": interval_excludes_zero("ci_low", "ci_high")})
    return rows.withColumns({
        "automated_screen_status": screen_status(criteria), "human_disposition": F.lit("pending"),
        "public_claim_approved": F.lit(False)})


def sensitivity_violations(primary: DataFrame, sensitivity: DataFrame, diagnostics: DataFrame,
                           threshold: float) -> DataFrame:
    """Sensitivity rows outside the candidate set, wrong tiers, wrong diagnostics; (problem, n)."""
    cand = primary.where(F.col("fdr_global") < threshold).select(
        *SIGNAL, F.col("analysis_tier").alias("expected_tier"))
    joined = sensitivity.join(cand, list(SIGNAL), "left")
    per_type = cand.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_expected"))
    seen = sensitivity.groupBy("cell_type", "scenario_id").agg(F.count(F.lit(1)).alias("n_seen"))
    d = diagnostics.join(per_type, "cell_type", "left").join(seen, ["cell_type", "scenario_id"], "left") \
        .fillna(0, ["n_seen", "n_expected"])
    parts = [
        joined.agg(F.count_if(F.col("expected_tier").isNull()).alias("non_candidate_rows"),
                   F.count_if(F.col("analysis_tier") != F.col("expected_tier")).alias("tier_mismatches")),
        d.agg(F.count_if(F.col("n_candidates_expected") != F.col("n_expected")).alias("wrong_denominators"),
              F.count_if(F.col("n_candidates_observed") != F.col("n_seen")).alias("wrong_observed_counts"),
              F.count_if((F.col("status") != "completed") & (F.col("n_seen") > 0)).alias("rows_without_fit")),
        cand.groupBy(*SIGNAL).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_candidates")),
    ]
    long = [p.unpivot([], p.columns, "problem", "n") for p in parts]
    return reduce(DataFrame.unionByName, long)


def candidate_evidence(primary: DataFrame, sensitivity: DataFrame, diagnostics: DataFrame,
                       threshold: float) -> DataFrame:
    """Per candidate gene and type: completed, observed and missing scenarios, concordance, effect
    range, largest change and the leave-one-batch-out block."""
    cand = primary.where(F.col("fdr_global") < threshold)
    done = diagnostics.where("status = 'completed'")
    out_kind = F.col("scenario_type") == LEAVE_OUT
    per_type = done.groupBy("cell_type").agg(
        F.count_distinct("scenario_id").alias("n_completed_scenarios"),
        F.count_if(out_kind).alias("n_leave_one_batch_out_completed"))
    e, m = F.col("s_effect"), F.col("effect")
    same = (effect_direction("s_effect") == effect_direction("effect")).cast("int")
    j = cand.select(*SIGNAL, "effect").join(sensitivity.select(
        *SIGNAL, "scenario_id", "scenario_type", F.col("effect").alias("s_effect")), list(SIGNAL))
    seen = j.groupBy(*SIGNAL).agg(
        F.count(F.lit(1)).alias("n_observed_scenarios"),
        F.avg(same).alias("direction_concordance_fraction"),
        F.min(e).alias("sensitivity_effect_min"), F.max(e).alias("sensitivity_effect_max"),
        F.max(F.abs(e - m)).alias("max_absolute_effect_change"),
        *[F.max(F.when(F.col("scenario_id") == s, e)).alias(f"{s}_effect") for s in REQUIRED_SCENARIOS],
        F.count_if(out_kind).alias("n_leave_one_batch_out_observed"),
        F.avg(F.when(out_kind, same)).alias("leave_one_batch_out_direction_concordance_fraction"),
        F.min(F.when(out_kind, e)).alias("leave_one_batch_out_effect_min"),
        F.max(F.when(out_kind, e)).alias("leave_one_batch_out_effect_max"))
    out = cand.join(seen, list(SIGNAL), "left").join(per_type, "cell_type", "left").fillna(0, [
        "n_observed_scenarios", "n_leave_one_batch_out_observed", "n_completed_scenarios",
        "n_leave_one_batch_out_completed"])
    return out.withColumns({
        "effect_direction": F.when(F.col("effect") > 0, "higher_with_age").otherwise("lower_with_age"),
        "n_missing_after_expression_filter": F.col("n_completed_scenarios") - F.col("n_observed_scenarios"),
        "requires_human_review": F.lit(True), "automated_disposition": F.lit("not_assigned")})


def review_queue(evidence: DataFrame, limit: int) -> DataFrame:
    """Best ``limit`` candidates per type and direction: FDR, then change, then gene."""
    if limit <= 0:
        raise ValueError("the queue size must be positive")
    order = [F.col("fdr_global").asc_nulls_last(), F.col("max_absolute_effect_change").asc_nulls_last(),
             F.col("gene_id")]
    return top_per_group(evidence, ["cell_type", "effect_direction"], order, limit,
                         "review_rank_within_direction").withColumn(
        "selection_reason", F.lit("top_global_fdr_within_celltype_and_direction_for_manual_review"))


def type_robustness(profiles: DataFrame, diagnostics: DataFrame, evidence: DataFrame, queue: DataFrame):
    """Profiles, support, age confounding of size and depth, scenario states and concordance per type."""
    batches = profiles.groupBy("cell_type", "batch").agg(F.count(F.lit(1)).alias("n")).groupBy("cell_type").agg(
        F.min("n").alias("minimum_profiles_per_batch"), F.count(F.lit(1)).alias("n_batches"))
    base = profiles.groupBy("cell_type").agg(
        F.count(F.lit(1)).alias("n_profiles"), F.count_distinct("sex").alias("n_sex_levels"),
        F.min("n_cells").alias("minimum_cells_per_profile"), F.min("library_size").alias("minimum_library_size"))
    med = wide_quantiles(profiles, ["cell_type"], "n_cells", {"median_cells_per_profile": 0.5}).join(
        wide_quantiles(profiles, ["cell_type"], "library_size", {"median_library_size": 0.5}), "cell_type")
    rho = spearman(profiles, ["cell_type"], "age", "n_cells", "spearman_age_vs_n_cells").join(
        spearman(profiles, ["cell_type"], "age", "library_size", "spearman_age_vs_library_size"), "cell_type")
    states = diagnostics.groupBy("cell_type").agg(*[
        F.count_if(F.col("status") == s).alias(f"n_scenarios_{n}")
        for s, n in (("completed", "completed"), ("not_estimable", "not_estimable"), ("model_failed", "failed"))])
    conc = evidence.groupBy("cell_type").agg(
        F.count(F.lit(1)).alias("n_global_fdr_candidates"),
        F.min("direction_concordance_fraction").alias("minimum_candidate_direction_concordance"))
    med_c = wide_quantiles(evidence, ["cell_type"], "direction_concordance_fraction",
                            {"median_candidate_direction_concordance": 0.5})
    queued = queue.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_review_queue_candidates"))
    out = base
    for part in (batches, med, rho, states, conc, med_c, queued):
        out = out.join(part, "cell_type", "left")
    return out.fillna(0, ["n_global_fdr_candidates", "n_review_queue_candidates"])


def prediction_screen(metrics: DataFrame) -> DataFrame:
    """The one best model: it must beat the baseline and its R2 interval must lie above zero."""
    best = metrics.where("is_best_model").agg(
        F.count(F.lit(1)).alias("n_best"), F.min("model").alias("model"), F.min("mae").alias("mae"),
        F.min("baseline_mae").alias("baseline_mae"), F.min("r2_ci_low").alias("r2_ci_low"))
    ok = (F.col("mae") < F.col("baseline_mae")) & (F.col("r2_ci_low") > 0)
    return best.withColumn("automated_screen_status", F.when(F.col("n_best") != 1, "invalid_best_model")
                           .when(ok, "candidate_for_human_review").otherwise("not_prioritized"))


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("automated_screen_status", "human_disposition").agg(
        F.count(F.lit(1)).alias("n_signals"), F.count_if("public_claim_approved").alias("n_approved"))


def evidence_id_lists(evidence: DataFrame, block: int = 1000) -> DataFrame:
    """``automated_screen_status, list_no, n_ids, signal_ids``: the signals of each status in order, in lists of at most ``block``."""
    status = "automated_screen_status"
    placed = sorted_position(evidence.select(status, "signal_id"), [status, "signal_id"], "__place")
    first = placed.groupBy(status).agg(F.min("__place").alias("__first"))
    numbered = placed.join(first, status).withColumn("list_no", F.floor((F.col("__place") - F.col("__first")) / block))
    return numbered.groupBy(status, "list_no").agg(F.count(F.lit(1)).alias("n_ids"), F.array_sort(F.collect_list("signal_id")).alias("signal_ids"))


def presentation_rows(associations: DataFrame, significant_only: bool = False, min_support: int | None = None, support: str = "n_subjects",
                      significant: str = "fdr_significant") -> DataFrame:
    """Associations that a report shows: with enough support, and significant ones only where asked. Null flags and supports don't pass."""
    out = associations
    if min_support is not None:
        out = out.where(F.col(support) >= min_support)
    return out.where(F.col(significant)) if significant_only else out


def association_matrix(associations: DataFrame, row: str, column: str, levels: list, value: str, fdr: str, fallback: str, alpha: float = 0.05) -> DataFrame:
    """One line per ``row``: for each level the mean value, least adjusted p value and whether any fit fell back.

    ``n_significant`` counts a line's levels whose least adjusted p value is below ``alpha``; ``place`` orders the lines by it, most
    first, then by name.
    """
    wide = associations.groupBy(row).pivot(column, levels).agg(
        F.avg(value).alias("value"), F.min(fdr).alias("fdr"), F.bool_or(fallback).alias("fallback"))
    found = [F.coalesce((F.col(f"`{v}_fdr`") < alpha).cast("int"), F.lit(0)) for v in levels]
    wide = keep(wide.withColumn("n_significant", sum(found[1:], found[0])).withColumn("__turn", -F.col("n_significant")), "matrix")
    return sorted_position(wide, ["__turn", row], "place").drop("__turn")
