"""Per-test statistics from sums: every test is a handful of numbers before anything is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortroll.operators.ordering import average_rank, running_counts
from cohortroll.operators.rollup import wide_quantiles
from cohortroll.session import keep


def pearson(x: str, y: str) -> Column:
    """Correlation aggregate; null for fewer than two rows or a constant side.

    A side is constant if its extremes are equal: merged deviations of a constant need not add up to zero.
    """
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """n, slope, intercept, R2, standard error of the slope and its t value per test."""
    s = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"), F.regr_avgx(y, x).alias("mx"), F.regr_avgy(y, x).alias("my"))
    slope = F.try_divide("sxy", "sxx")
    s = s.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    s = s.withColumn("r_squared", F.try_divide(
        F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    s = s.withColumn("slope_se", F.when(F.col("n") > 2, F.sqrt(F.try_divide(
        rest, (F.col("n") - 2) * F.col("sxx")))))
    return s.withColumn("t_value", F.try_divide("slope", "slope_se")).drop(
        "sxx", "syy", "sxy", "mx", "my")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "spearman_rho"):
    """Rank correlation per test over rows where both sides are known."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = average_rank(both, ["__x", "__y"], keys, ["__rx", "__ry"])
    return ranked.groupBy(*keys).agg(pearson("__rx", "__ry").alias(out))


def folded_spearman(folded: DataFrame, keys: Sequence[str], x: str, y: str, n: str, out: str = "spearman_rho") -> DataFrame:
    """``spearman`` of rows folded to distinct (x, y) with their number ``n``; both known in all of them."""
    ranked = folded
    for value, rank in ((x, "__rx"), (y, "__ry")):
        upto = running_counts(folded, value, keys, weight=F.col(n))
        centred = F.col("n_upto") - (F.col("n") - 1) / 2.0 - (F.col("n_total") + 1) / 2.0
        ranked = ranked.join(upto.select(*keys, value, centred.alias(rank)), [*keys, value])
    a, b = F.col("__rx"), F.col("__ry")
    rho = F.try_divide(F.sum(F.col(n) * a * b), F.sqrt(F.sum(F.col(n) * a * a)) * F.sqrt(F.sum(F.col(n) * b * b)))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return ranked.groupBy(*keys).agg(F.when(varies, rho).alias(out))


def level_means(df: DataFrame, keys: Sequence[str], factor: str, columns: Sequence[str]) -> DataFrame:
    """Mean of each column per test and level, as ``__m_<column>``."""
    return df.groupBy(*keys, factor).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])


def demean(df: DataFrame, keys: Sequence[str], factor: str, columns: Sequence[str], means: DataFrame | None = None) -> DataFrame:
    """Residuals on one factor: the value less its level mean inside the test (``means``, if already known)."""
    means = level_means(df, keys, factor, columns) if means is None else means
    return df.join(means, [*keys, factor]).withColumns(
        {f"{c}_resid": F.col(c) - F.col(f"__m_{c}") for c in columns}).drop(
        *[f"__m_{c}" for c in columns])


def residual_violations(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Tests whose residual has no usable variation."""
    flat = df.groupBy(*keys).agg(*[F.stddev_pop(c).alias(c) for c in columns])
    return flat.unpivot(list(keys), list(columns), "variable", "sd").where("sd < 1e-8")


def prediction_metrics(df: DataFrame, keys: Sequence[str], truth: str, pred: str, base: str):
    """Error, fit and correlation of predictions per model, with the baseline error and the gain."""
    e, b = F.col(truth) - F.col(pred), F.col(truth) - F.col(base)
    med = wide_quantiles(df.withColumn("__ae", F.abs(e)), keys, "__ae", {"median_ae": 0.5})
    main = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(truth))).alias("r2"),
        pearson(truth, pred).alias("pearson_r"),
        F.avg((F.abs(e) <= 5).cast("int")).alias("within_5y"),
        F.avg(F.abs(b)).alias("baseline_mae"))
    main = main.withColumn("mae_gain", F.col("baseline_mae") - F.col("mae"))
    keys = list(keys)
    return main.join(med, keys).join(spearman(df, keys, truth, pred, "spearman_rho"), keys)


def age_terms(df: DataFrame, keys: Sequence[str], age: str = "age") -> DataFrame:
    """Adds ``age_decade`` centred inside the test, from the test mean joined back.

    The means are written, so Spark knows how few they are and rows aren't shuffled by test to meet them.
    """
    means = keep(df.groupBy(*keys).agg(F.avg(age).alias("__mean_age")), "mean-age")
    return df.join(means, list(keys)).withColumn(
        "age_decade", (F.col(age) - F.col("__mean_age")) / 10).drop("__mean_age")


def clustered_age_effect(df: DataFrame, keys: Sequence[str], subject: str, y: str,
                         age: str = "age") -> DataFrame:
    """Gaussian working-independence fit with subject-clustered covariance, in closed form.

    The tests' totals need no subjects; they are written first, so subjects' sums become scores where they are.
    """
    d = age_terms(df, keys, age)
    x = F.col("age_decade")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(x * x).alias("xx"),
            F.sum(y).alias("y"), F.sum(x * F.col(y)).alias("xy")]
    tot = d.groupBy(*keys).agg(*sums).select(*keys, *[F.col(c).alias(f"t_{c}") for c in ("n", "x", "xx", "y", "xy")])
    det = F.col("t_n") * F.col("t_xx") - F.col("t_x") * F.col("t_x")
    tot = tot.withColumn("det", F.nullif(det, F.lit(0.0)))
    tot = tot.withColumn("b1", (F.col("t_n") * F.col("t_xy") - F.col("t_x") * F.col("t_y")) / F.col("det"))
    tot = keep(tot.withColumn("b0", (F.col("t_y") - F.col("b1") * F.col("t_x")) / F.col("t_n")), "totals")
    per = d.groupBy(*keys, subject).agg(*sums)
    j = per.join(tot, list(keys))
    u0 = F.col("y") - F.col("b0") * F.col("n") - F.col("b1") * F.col("x")
    u1 = F.col("xy") - F.col("b0") * F.col("x") - F.col("b1") * F.col("xx")
    # Row of the inverse bread that belongs to the age term.
    score = (F.col("t_n") * u1 - F.col("t_x") * u0) / F.col("det")
    out = j.groupBy(*keys, F.col("t_n").alias("n_observations"), F.col("b1").alias("effect_per_10y")).agg(
        F.count(F.lit(1)).alias("n_subjects"), F.sqrt(F.sum(score * score)).alias("standard_error"))
    return out.select(*keys, "n_subjects", "n_observations", "effect_per_10y", "standard_error",
                      F.try_divide("effect_per_10y", "standard_error").alias("z_value"))
