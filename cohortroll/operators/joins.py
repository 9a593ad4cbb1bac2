"""Equi-joins with the cardinality contracts that a plain join does not check.

No broadcast hints: a side is broadcast only when its measured size is below the session's
threshold, and beyond it the same plan runs as a sort-merge join with skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortroll.functions.scalar import clean_text, is_present
from cohortroll.operators.contracts import enforce


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def collapse_exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows equal in every column become one row."""
    return df.groupBy(*df.columns).agg(F.lit(1).alias("__one")).drop("__one")


def conflicting_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that still carry more than one payload after the exact-duplicate collapse."""
    return duplicate_keys(collapse_exact_duplicates(df), [key])


def many_to_one_left(left: DataFrame, right: DataFrame, key: str, *, check: bool = True,
                     allow_unmatched: bool = False, flag: str = "metadata_matched") -> DataFrame:
    """Left rows are kept one for one; the right key is unique; unmatched rows are an error."""
    right = right.where(F.col(key).isNotNull())
    if check:
        enforce(duplicate_keys(right, [key]), "right key is not unique")
        enforce(left.where(F.col(key).isNull()).select(key), "left key has nulls")
    out = left.join(right.withColumn(flag, F.lit(True)), key, "left") \
        .withColumn(flag, F.coalesce(flag, F.lit(False)))
    if check and not allow_unmatched:
        enforce(out.where(~F.col(flag)).select(key), "rows without metadata")
    return out


def coalesce_prefer_right(df: DataFrame, base: str, left: str, right: str) -> DataFrame:
    """Right value when present, with where it came from and whether the two sides disagree."""
    has_left, has_right = is_present(left), is_present(right)
    lv, rv = F.col(left).cast("string"), F.col(right).cast("string")
    return (
        df.withColumn(base, F.when(has_right, rv).when(has_left, lv))
        .withColumn(f"{base}_source", F.when(has_right, "external").when(has_left, "original")
                    .otherwise("missing"))
        .withColumn(f"{base}_conflict", has_left & has_right & (F.trim(lv) != F.trim(rv)))
    )


def status_by_key(rows: DataFrame, results: DataFrame, keys: Sequence[str], status: str = "status",
                  absent: str = "absent", clash: str = "conflicting") -> DataFrame:
    """The status of each row's result, looked up by keys in which null and blank are the same.

    A key without a result has the status ``absent``; one whose results disagree, or hold an unknown
    status, ``clash``. Rows keep their own key values.
    """
    def plain(df, prefix):
        return df.withColumns({f"{prefix}{k}": F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys})

    own = [f"__{k}" for k in keys]
    known = plain(results, "__").groupBy(*own).agg(
        F.when((F.count_distinct(status) == 1) & (F.count(status) == F.count(F.lit(1))), F.min(status)).otherwise(clash).alias("__status"))
    return plain(rows.drop(status), "__").join(known, own, "left").withColumn(
        status, F.coalesce("__status", F.lit(absent))).drop(*own, "__status")


def attach_units(cells: DataFrame, mapping: DataFrame, units: Sequence[str], *,
                 check: bool = True) -> DataFrame:
    """Unit ids per cell: cleaned in place when present, otherwise looked up by cell id."""
    if all(u in cells.columns for u in units):
        out = cells.withColumns({u: clean_text(u) for u in units})
    else:
        units_only = mapping.select("cell_id", *[clean_text(u).alias(u) for u in units])
        out = many_to_one_left(cells, units_only, "cell_id", check=False, allow_unmatched=True,
                               flag="unit_matched")
    if check:
        bad = reduce(lambda a, b: a | b, [F.col(u).isNull() for u in units])
        enforce(out.where(bad).select("cell_id", *units), "cells without unit ids")
    return out


def cover_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, from a single full outer pass."""
    a = left.groupBy(key).agg(F.lit(True).alias("in_left"))
    b = right.groupBy(key).agg(F.lit(True).alias("in_right"))
    return a.join(b, key, "full").where(F.col("in_left").isNull() | F.col("in_right").isNull()) \
        .select(key, F.when(F.col("in_left").isNull(), "right_only").otherwise("left_only")
                .alias("side"))


def attach_analysis_labels(cells: DataFrame, mapping: DataFrame, raw: str = "raw_label"):
    """Disposition for every cell; the analysis label only for primary ones."""
    dims = mapping.select(raw, "disposition", "analysis_label")
    return cells.join(dims, raw, "left").withColumn(
        "analysis_label", F.when(F.col("disposition") == "primary", F.col("analysis_label")))


def structural_zero_grid(totals: DataFrame, counts: DataFrame, sample: str, types: DataFrame,
                         type_col: str = "cell_type", max_types: int = 10_000) -> DataFrame:
    """Every sample with every observed type; absent pairs count 0.

    The list of types is one checked scalar that is unfolded per sample, so there is no product
    join, and (sample, type) is unique on both sides of the join that follows.
    """
    listed = types.select(type_col).distinct().agg(F.array_sort(F.collect_list(type_col)).alias("t"))
    guarded = listed.select(
        F.when(F.size("t") <= max_types, F.col("t"))
        .otherwise(F.raise_error(F.lit(f"more than {max_types} types"))).alias("t"))
    grid = totals.withColumn(type_col, F.explode(guarded.scalar()))
    return grid.join(counts, [sample, type_col], "left").fillna(0, subset=["n_cells"])


def compare_results(old: DataFrame, new: DataFrame, keys: Sequence[str], threshold: float = 0.05):
    """Full outer one-to-one join of two result sets with a status per row.

    Later statuses override earlier ones, in the order of the ``when`` chain read bottom up.
    """
    a = old.select(*keys, F.col("effect").alias("provisional_effect"),
                   F.col("fdr").alias("provisional_fdr"))
    b = new.select(*keys, F.col("effect").alias("corrected_effect"),
                   F.col("fdr").alias("corrected_fdr"))
    pe, ce = F.col("provisional_effect"), F.col("corrected_effect")
    was = F.coalesce(F.col("provisional_fdr") < threshold, F.lit(False))
    now = F.coalesce(F.col("corrected_fdr") < threshold, F.lit(False))
    both = pe.isNotNull() & ce.isNotNull()
    status = (
        F.when(both & was & ~now, "lost_support")
        .when(both & ~was & now, "newly_supported")
        .when(both & (F.signum(pe) != F.signum(ce)), "direction_changed")
        .when(ce.isNull(), "no_longer_testable")
        .when(pe.isNull(), "newly_testable")
        .otherwise("stable_direction")
    )
    return a.join(b, list(keys), "full").select(
        *keys, pe, F.col("provisional_fdr"), ce, F.col("corrected_fdr"),
        was.alias("provisional_supported"), now.alias("corrected_supported"),
        status.alias("comparison_status"), (ce - pe).alias("effect_change"))


def compare_metrics(old: DataFrame, new: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Full outer join of model metrics: comparable, or the set of models changed."""
    a = old.select(*keys, F.col(metric).alias("provisional_value"))
    b = new.select(*keys, F.col(metric).alias("corrected_value"))
    both = F.col("provisional_value").isNotNull() & F.col("corrected_value").isNotNull()
    return a.join(b, list(keys), "full").withColumn(
        "comparison_status", F.when(both, "comparable").otherwise("model_set_changed")) \
        .withColumn("value_change", F.col("corrected_value") - F.col("provisional_value"))


def apply_review(mapping: DataFrame, review: DataFrame, key: str = "raw_label") -> DataFrame:
    """Reviewed decisions replace mapping fields; ``problem`` names rows that break the rules."""
    fields = ("disposition", "analysis_label", "review_status", "rationale")
    new = review.select(key, *[F.col(f).alias(f"new_{f}") for f in fields],
                        F.lit(True).alias("__reviewed"))
    old = mapping.withColumn("__mapped", F.lit(True))
    joined = old.join(new, key, "full")
    out = joined.select(
        key, *[F.coalesce(f"new_{f}", f).alias(f) for f in fields], "__reviewed", "__mapped")
    problem = (
        F.when(F.col("__mapped").isNull(), "review_row_not_in_mapping")
        .when(F.col("__reviewed").isNull(), "label_not_reviewed")
        .when(F.col("review_status") != "approved", "not_approved")
        .when((F.col("disposition") == "primary") & F.col("analysis_label").isNull(),
              "primary_without_analysis_label")
        .otherwise("")
    )
    return out.withColumn("problem", problem).drop("__reviewed", "__mapped")


def apply_dispositions(evidence: DataFrame, decisions: DataFrame, key: str = "signal_id"):
    """Human decisions onto candidate rows; approval only counts for retained signals."""
    chosen = decisions.select(key, F.col("decision").alias("__decision"),
                              F.col("approve").alias("__approve"))
    return evidence.join(chosen, key, "left").withColumns({
        "human_disposition": F.coalesce("__decision", F.lit("pending")),
        "public_claim_approved": F.coalesce(
            F.col("__approve") & (F.col("__decision") == "retain"), F.lit(False)),
    }).drop("__decision", "__approve")


def disposition_violations(evidence: DataFrame, decisions: DataFrame, key: str = "signal_id"):
    """Decisions that match no candidate or more than one, or approve a row not retained."""
    candidates = evidence.where(F.col("automated_screen_status") == "candidate_for_human_review") \
        .groupBy(key).agg(F.count(F.lit(1)).alias("n_match"))
    joined = decisions.join(candidates, key, "left")
    problem = (
        F.when(F.col("n_match").isNull(), "no_candidate")
        .when(F.col("n_match") > 1, "ambiguous_candidate")
        .when(F.col("approve") & (F.col("decision") != "retain"), "approved_but_not_retained")
    )
    return joined.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())
