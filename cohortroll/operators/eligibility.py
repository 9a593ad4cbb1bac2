"""Which labels qualify for which analysis, with ordered reasons when they do not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortroll.functions.resolve import require_disjoint_lists
from cohortroll.operators.glm import design_diagnostics, indicator_columns
from cohortroll.operators.rollup import reasons
from cohortroll.operators.stats import age_terms
from cohortroll.session import keep


def method_eligibility_table(profiles: DataFrame, methods: Sequence[tuple[str, bool, int]], *, min_cells: int,
                             min_age_span: float = 12, covariates: Sequence[str] = ("sex",)) -> DataFrame:
    """Each method contract (name, uses every sample, subjects needed) against each label."""
    items = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(e).alias("every"), F.lit(n).alias("need"))
                      for m, e, n in methods])
    rows = profiles.select("*", F.inline(items)).where(F.col("every") | (F.col("n_cells") >= min_cells))
    keys = ["method", "cell_type"]
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sample_units"), F.count_distinct("subject_id").alias("n_subjects"),
        (F.max("age") - F.min("age")).alias("age_span"), F.max("need").alias("need"))
    d, x, groups = indicator_columns(rows, list(covariates))
    design = design_diagnostics(age_terms(d, keys), keys, x, groups, "age_decade")
    j = base.join(design, keys).withColumn("exclusion_reasons", reasons(
        (F.col("n_subjects") < F.col("need"), "insufficient_subjects"),
        (F.col("age_span") < min_age_span, "insufficient_age_span"), (~F.col("estimable"), "design_not_estimable")))
    return j.select(*keys, "n_sample_units", "n_subjects", "age_span", "exclusion_reasons",
                    (F.col("exclusion_reasons") == "").alias("eligible"), "design_rank")


def pseudobulk_eligibility_table(profiles: DataFrame, primary: Sequence[str], exploratory: Sequence[str], *,
                                 min_cells: int = 50, min_samples: int = 12, min_subjects: int = 12,
                                 min_age_span: float = 12, min_residual_df: int = 5) -> DataFrame:
    """Tier, support, design and ordered exclusion reasons per observed or configured type."""
    require_disjoint_lists(primary, exploratory)
    tiers = F.when(F.col("cell_type").isin(*primary), "primary").when(
        F.col("cell_type").isin(*exploratory), "exploratory").otherwise("not_approved")
    ok = F.col("n_cells") >= min_cells
    base = profiles.groupBy("cell_type").agg(
        F.count(F.lit(1)).alias("n_sample_units_observed"), F.count_if(ok).alias("n_sample_units_qualifying"),
        F.count_distinct("subject_id").alias("n_subjects_observed"),
        F.count_distinct(F.when(ok, F.col("subject_id"))).alias("n_subjects_qualifying"),
        (F.max(F.when(ok, F.col("age"))) - F.min(F.when(ok, F.col("age")))).alias("age_span_years"))
    good = keep(profiles.where(ok), "qualifying")
    repeated = good.groupBy("cell_type", "subject_id").agg(F.count(F.lit(1)).alias("k")).groupBy("cell_type").agg(
        F.count_if(F.col("k") > 1).alias("n_repeated_subjects"))
    d, x, groups = indicator_columns(age_terms(good, ["cell_type"]), ["sex", "batch"])
    design = design_diagnostics(d, ["cell_type"], x, groups, "age_decade", min_residual_df).select(
        "cell_type", "design_columns", "design_rank", "residual_df", "estimable")
    j = base.join(repeated, "cell_type", "left").join(design, "cell_type", "left").withColumn("analysis_tier", tiers)
    why = reasons(
        (F.col("analysis_tier") == "not_approved", "not_approved_by_analysis_contract"),
        (F.col("n_sample_units_qualifying") < min_samples, "insufficient_qualifying_sample_units"),
        (F.col("n_subjects_qualifying") < min_subjects, "insufficient_qualifying_subjects"),
        (F.coalesce(F.col("age_span_years") < min_age_span, F.lit(True)), "insufficient_age_span"),
        (F.coalesce(F.col("design_rank") < F.col("design_columns"), F.lit(True)), "fixed_effect_design_not_estimable"),
        (F.coalesce(F.col("n_repeated_subjects") < 1, F.lit(True)), "no_repeated_subject_support"),
        (F.coalesce(F.col("residual_df") < min_residual_df, F.lit(True)), "insufficient_full_model_residual_df"))
    j = j.withColumn("exclusion_reasons", why)
    # Configured types never observed still get a row.
    asked = F.explode(F.array(*[F.lit(t) for t in (*primary, *exploratory)])).alias("cell_type")
    one = base.agg(F.count(F.lit(1)).alias("n"))
    missing = one.select(asked).join(base.select("cell_type"), "cell_type", "left_anti").withColumn("analysis_tier", tiers) \
        .withColumn("exclusion_reasons", F.lit("configured_cell_type_not_observed"))
    out = j.unionByName(missing, allowMissingColumns=True).fillna(0, [
        "n_sample_units_observed", "n_sample_units_qualifying", "n_subjects_observed", "n_subjects_qualifying",
        "n_repeated_subjects", "design_columns", "design_rank", "residual_df"])
    return out.withColumn("aggregation_status", F.when(F.col("exclusion_reasons") == "", "included").otherwise("excluded"))
