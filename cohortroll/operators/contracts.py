"""Contracts as violation tables. A violation table is empty when the data keeps the contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_LEVEL = "\u0000null"


class ContractError(ValueError):
    """Raised by :func:`enforce` with a few example violations."""


def enforce(violations: DataFrame, context: str) -> None:
    examples = violations.limit(5).collect()
    if examples:
        raise ContractError(f"{context}: " + "; ".join(str(r.asDict()) for r in examples))


def distinct_levels(col: str) -> Column:
    """Number of distinct values where null counts as one."""
    return F.count_distinct(F.coalesce(F.col(col).cast("string"), F.lit(NULL_LEVEL)))


def inconsistent_attributes(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """(key, attribute, n_levels) wherever a key carries more than one value.

    Repeated pairs are folded first, so a hot key reaches the second step as a few rows.
    """
    folded = df.groupBy(key, *attributes).agg(F.lit(1).alias("__one"))
    wide = folded.groupBy(key).agg(*[distinct_levels(a).alias(a) for a in attributes])
    return wide.unpivot(key, list(attributes), "attribute", "n_levels").where("n_levels > 1")


def missing_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, n_missing) for each column that has nulls."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "attribute", "n_missing").where("n_missing > 0")


def replicate_covariate_violations(df, replicate: str, covariates: Sequence[str]) -> DataFrame:
    """Incomplete or inconsistent covariates, as one table."""
    gaps = missing_values(df, covariates).select(
        F.lit("missing").alias("problem"), "attribute", F.lit("").alias("example"),
        F.col("n_missing").alias("n"))
    clashes = inconsistent_attributes(df, replicate, covariates).groupBy("attribute").agg(
        F.min(F.col(replicate).cast("string")).alias("example"), F.count(F.lit(1)).alias("n"))
    return gaps.unionByName(
        clashes.select(F.lit("inconsistent").alias("problem"), "attribute", "example", "n"))


def sample_rule_violations(rows: DataFrame, subject: str = "subject_id", sample: str = "sample_unit_id",
                           age: str = "age") -> DataFrame:
    """(problem, n): what keeps a table from the one-sample-per-subject rule; no rows if nothing does.

    Rows whose subject or sample is null or blank, rows without a finite age, and samples that carry
    two subjects or two ages. A sample of any size is folded to its distinct pairs first.
    """
    blank = {f"missing_{n}": F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
             for n, c in (("subject", subject), ("sample", sample))}
    number = F.col(age).cast("double")
    blank["missing_age"] = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    gaps = rows.agg(*[F.count_if(c).alias(n) for n, c in blank.items()]).unpivot([], list(blank), "problem", "n")
    pairs = rows.where(~blank["missing_sample"]).groupBy(F.col(sample).alias("__sample"), F.col(subject).alias("subject"), number.alias("age")).agg(
        F.lit(1).alias("__one")).groupBy("__sample").agg(
        *[(F.count_distinct(c) > 1).alias(f"conflicting_{c}") for c in ("subject", "age")])
    kinds = ["conflicting_subject", "conflicting_age"]
    clashes = pairs.agg(*[F.count_if(F.col(k)).alias(k) for k in kinds]).unpivot([], kinds, "problem", "n")
    return gaps.unionByName(clashes).where("n > 0")


def sample_metadata(cells: DataFrame, sample: str = "sample_unit_id", subject: str = "subject_id",
                    age: str = "age", sex: str = "sex", batch: str = "batch") -> DataFrame:
    """One row per sample unit: first non-null subject, age, sex, batch and age in decades."""
    return cells.groupBy(sample).agg(
        *[F.min(c).alias(n) for c, n in
          ((subject, "subject_id"), (age, "age"), (sex, "sex"), (batch, "batch"))],
    ).withColumn("age_decade", F.col("age").cast("double") / 10)


def sample_metadata_violations(cells: DataFrame, sample="sample_unit_id", subject="subject_id",
                               age="age", sex="sex", batch="batch") -> DataFrame:
    """Clashes inside a sample unit, gaps in its metadata, and subjects with two sexes."""
    inside = inconsistent_attributes(cells, sample, [subject, age, sex, batch]).select(
        F.lit("inconsistent_in_sample").alias("problem"), F.col(sample).alias("unit"), "attribute")
    table = sample_metadata(cells, sample, subject, age, sex, batch)
    fields = ["subject_id", "age", "sex", "batch"]
    gaps = table.select(
        F.col(sample).alias("unit"),
        F.explode(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields]),
                           lambda x: x.isNotNull())).alias("attribute"),
    ).select(F.lit("missing").alias("problem"), "unit", "attribute")
    sexes = inconsistent_attributes(table, "subject_id", ["sex"]).select(
        F.lit("inconsistent_in_subject").alias("problem"), F.col("subject_id").alias("unit"),
        "attribute")
    return inside.unionByName(gaps).unionByName(sexes)


def count_violations(counts: DataFrame, value: str = "count", tolerance: float = 1e-6):
    """One row: non-finite, negative and fractional entries."""
    v = F.col(value).cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(~finite | v.isNull()).alias("n_non_finite"),
        F.count_if(finite & (v < 0)).alias("n_negative"),
        F.count_if(finite & (F.abs(v - F.round(v)) > tolerance)).alias("n_fractional"),
    )


def label_metadata_completeness(cells: DataFrame, required: Sequence[str], label: str):
    """Null labels only exclude a cell; null metadata is a failure."""
    usable = F.lit(True)
    for c in required:
        usable = usable & F.col(c).isNotNull()
    return cells.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(usable & F.col(label).isNotNull()).alias("n_eligible"),
        F.count_if(F.col(label).isNull()).alias("n_excluded_null_label"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_missing_{c}") for c in required],
    )


# The label dispositions and review states a mapping may use.
DISPOSITIONS = ("primary", "exploratory", "unresolved", "exclude")
REVIEW_STATES = ("pending", "approved")


def mapping_violations(mapping: DataFrame, observed: DataFrame, raw: str = "raw_label"):
    """Every way a label mapping can be invalid, as (problem, label) rows."""
    def rows(df, problem, label=raw):
        return df.select(F.lit(problem).alias("problem"), F.col(label).cast("string").alias("label"))

    blank = F.trim(F.coalesce(F.col("rationale"), F.lit(""))) == ""
    labels = observed.select(F.col(raw)).distinct()
    parts = [
        rows(mapping.groupBy(raw).count().where("count > 1"), "duplicate_label"),
        rows(mapping.where(~F.col("disposition").isin(*DISPOSITIONS)), "bad_disposition"),
        rows(mapping.where(~F.col("review_status").isin(*REVIEW_STATES)), "bad_review_status"),
        rows(mapping.where(blank), "missing_rationale"),
        rows(mapping.where((F.col("disposition") == "primary") & F.col("analysis_label").isNull()),
             "primary_without_analysis_label"),
        rows(labels.join(mapping, raw, "left_anti"), "observed_but_unmapped"),
        rows(mapping.join(labels, raw, "left_anti"), "mapped_but_unobserved"),
        rows(mapping.agg(F.count_distinct("mapping_version").alias("v"))
             .where("v <> 1").withColumn("v", F.col("v").cast("string")), "several_versions", "v"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mapping_is_approved(mapping: DataFrame) -> DataFrame:
    return mapping.agg(
        F.coalesce(F.bool_and(F.col("review_status") == "approved"), F.lit(False)).alias("approved"),
        F.count(F.lit(1)).alias("n_rows"))


def denominator_label(cells: DataFrame, label: str, disposition: str,
                      other: str = "Other/unresolved") -> DataFrame:
    """Non-primary cells keep their place in the denominator under one label that is not tested."""
    primary = F.col(disposition) == "primary"
    return cells.withColumn("cell_type", F.when(primary, F.col(label)).otherwise(F.lit(other))) \
        .withColumn("denominator_only", ~primary)


def check_rows(checks: Mapping[str, tuple[Column, Column, str]]) -> list[Column]:
    """Structs (name, passed, severity, detail) for one-pass check tables."""
    return [
        F.struct(F.lit(name).alias("name"), passed.alias("passed"),
                 F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
        for name, (passed, detail, severity) in checks.items()
    ]


def checks_from(summary: DataFrame, checks) -> DataFrame:
    """One summary row becomes one row per check: a single pass over the data for all checks."""
    return summary.select(F.inline(F.array(*check_rows(checks))))


def overall(checks: DataFrame) -> DataFrame:
    """Passes only when no error-level check failed."""
    return checks.agg(
        F.bool_and(F.col("passed") | (F.col("severity") != "error")).alias("passed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("n_failed_errors"),
        F.count(F.lit(1)).alias("n_checks"))
