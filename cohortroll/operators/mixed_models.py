"""Random-intercept models per (cell type, gene), clustered by subject, with moderated tests.

For a variance ratio the restricted likelihood, and its first two derivatives by the ratio, need only sums per subject. A short
grid of ratios, carried as rows and narrowed, finds the neighbourhood; steps by the derivatives end at the optimum. The same
derivatives give the denominator degrees of freedom of the age effect: twice its squared variance over the variance of that
variance, by the observed information of the two variance components. Residual variances are moderated across a type's genes.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortroll.functions.tails import t_two_sided
from cohortroll.operators import expression as ex
from cohortroll.operators.glm import pairs, scaled_rank, square, sum_array
from cohortroll.session import dealt, keep

KEYS = ["cell_type", "gene_id"]
POLISH = 4  # steps by the derivatives
NEGLIGIBLE = 1e-9  # a ratio below it is a fit without subject variance


def subject_sums(weighted: DataFrame, x: Sequence[str], value: str, weight: str) -> DataFrame:
    """Sums per gene and subject, with the gene's mean weight: the ratio is relative to it, so one grid serves every gene.

    A subject's rows are few and its sums wide, so rows of large tables are dealt by subject and summed where they meet. The sums
    are written once; mean weights, a row a gene, are joined to them where they are read.
    """
    p = len(x)
    per = keep(dealt(weighted, weighted.count(), "subject_id").groupBy(*KEYS, "subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"sum(`{weight}`)").alias("w"),
        sum_array(f"`{weight}` * `{x[i]}` * `{x[j]}`" for i, j in pairs(p)).alias("xx"),
        sum_array(f"`{weight}` * `{c}`" for c in x).alias("xs"),
        sum_array(f"`{weight}` * `{c}` * `{value}`" for c in x).alias("xy"),
        F.expr(f"sum(`{weight}` * `{value}`)").alias("y"), F.expr(f"sum(`{weight}` * `{value}` * `{value}`)").alias("yy")), "subjects")
    scale = keep(per.groupBy(*KEYS).agg((F.sum("w") / F.sum("n")).alias("mw")), "mean-weights")
    return per.join(scale, KEYS)


def at_ratio(rows: DataFrame, p: int, derivatives: bool = False) -> DataFrame:
    """Sums over subjects at each row's ``ratio``: design products ``m``, ``h`` and ``yy`` after the intercepts are taken out.

    ``derivatives`` adds those sums' first (``m1`` ...) and second derivatives (``m2`` ...) by the ratio.
    """
    at = {pq: i for i, pq in enumerate(pairs(p))}
    w = "(w / mw)"
    terms = {"": (f"(ratio / (1 + ratio * {w}) / mw)", True)}
    if derivatives:
        terms |= {"1": (f"(1 / pow(1 + ratio * {w}, 2) / mw)", False), "2": (f"(-2 * {w} / pow(1 + ratio * {w}, 3) / mw)", False)}
    sums = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_subjects"), F.expr(f"sum(ln(1 + ratio * {w}))").alias("logdet")]
    if derivatives:
        sums += [F.expr(f"sum({w} / (1 + ratio * {w}))").alias("logdet1"), F.expr(f"sum(-pow({w} / (1 + ratio * {w}), 2))").alias("logdet2")]
    for tag, (g, plain) in terms.items():
        of = lambda whole, part: f"{whole} - {g} * {part}" if plain else f"- {g} * {part}"
        sums += [sum_array(of(f"xx[{at[i, j]}]", f"xs[{i}] * xs[{j}]") for i, j in at).alias(f"m{tag}"),
                 sum_array(of(f"xy[{i}]", f"xs[{i}] * y") for i in range(p)).alias(f"h{tag}"), F.expr(f"sum({of('yy', 'y * y')})").alias(f"yy{tag}")]
    return rows.groupBy(*KEYS, "ratio").agg(*sums)


class Profile:
    """Restricted likelihood of one model at one ratio, from its sums, with derivatives by the ratio."""

    def __init__(self, r, p: int):
        full, h = square(np.asarray(r.m, float), p), np.asarray(r.h, float)
        self.used = np.diag(full) > 1e-12
        part = np.ix_(self.used, self.used)
        self.m, self.h = full[part], h[self.used]
        self.df = int(r.n) - int(self.used.sum())
        # Whether the design can be estimated shows without subject variance; beyond, products nearly cancel.
        self.estimable = bool(self.df > 0 and self.used[-1] and (scaled_rank(self.m) == len(self.m) if r.ratio == 0 else np.linalg.det(self.m) > 0))
        if not self.estimable:
            return
        self.inv = np.linalg.inv(self.m)
        self.beta = self.inv @ self.h
        self.q = max(float(r.yy - self.h @ self.beta), 1e-300)
        self.sigma2 = self.q / self.df
        self.ll = -0.5 * (self.df * np.log(self.sigma2) + r.logdet + np.linalg.slogdet(self.m)[1])
        if not hasattr(r, "m1"):
            return
        m1, m2 = (square(np.asarray(v, float), p)[part] for v in (r.m1, r.m2))
        h1, h2 = (np.asarray(v, float)[self.used] for v in (r.h1, r.h2))
        moved = h1 - m1 @ self.beta
        self.q1 = r.yy1 - 2 * h1 @ self.beta + self.beta @ m1 @ self.beta
        self.q2 = r.yy2 - 2 * h2 @ self.beta + self.beta @ m2 @ self.beta - 2 * moved @ self.inv @ moved
        turn = self.inv @ m1
        self.det1 = r.logdet1 + np.trace(turn)
        self.det2 = r.logdet2 + np.trace(self.inv @ m2) - np.trace(turn @ turn)
        self.slope = -0.5 * (self.df * self.q1 / self.q + self.det1)
        self.bend = -0.5 * (self.df * (self.q2 / self.q - (self.q1 / self.q) ** 2) + self.det2)
        self.inv1 = -(turn @ self.inv)[-1, -1]

    def denominator_df(self, ratio: float) -> float:
        """Degrees of freedom of the last coefficient; the residual ones where subjects add no variance."""
        if ratio < NEGLIGIBLE:
            return float(self.df)
        s2, unit = self.sigma2, self.inv[-1, -1]
        info = np.array([[self.df / (2 * s2**2), -self.q1 / (2 * s2**2)], [-self.q1 / (2 * s2**2), 0.5 * (self.det2 + self.q2 / s2)]])
        gradient = np.array([unit, s2 * self.inv1])
        if np.linalg.det(info) <= 0 or info[0, 0] <= 0:
            return float(self.df)
        spread = gradient @ np.linalg.solve(info, gradient)
        return float(np.clip(2 * (s2 * unit) ** 2 / spread, 1.0, 1e7)) if spread > 0 else float(self.df)


def mixed_model(weighted: DataFrame, x: Sequence[str], value: str, weight: str, rounds: int = 2) -> DataFrame:
    """One row per (type, gene): age effect, its standard error and unscaled part, variances, degrees of freedom of both kinds.

    A model whose age column can't be told from the others is left out.
    """
    p = len(x)
    per = subject_sums(weighted, x, value, weight)

    @F.pandas_udf("double")
    def likelihood(rows: pd.DataFrame) -> pd.Series:
        fits = [Profile(r, p) for r in rows.itertuples(index=False)]
        return pd.Series([f.ll if f.estimable else np.nan for f in fits], dtype=float)

    best = None
    for step in range(rounds):
        if best is None:
            cand = per.withColumn("ratio", F.explode(F.array(F.lit(0.0), *[F.lit(float(v)) for v in np.geomspace(1e-3, 1e2, 12)])))
        else:
            spread = 2.9 ** (1 / 6 ** (step - 1))
            steps = F.array(*[F.lit(float(s)) for s in np.geomspace(1 / spread, spread, 9)])
            # A best ratio of 0 gives 0 at every step; repeats would count the subjects several times.
            cand = per.join(best.select(*KEYS, F.col("ratio").alias("centre")), KEYS).withColumn("ratio", F.explode(F.array_distinct(
                F.transform(steps, lambda s: s * F.col("centre"))))).drop("centre")
        fit = at_ratio(cand, p).withColumn("ll", likelihood(F.struct("ratio", "m", "h", "yy", "logdet", "n"))).where("ll is not null and not isnan(ll)")
        top = fit.groupBy(*KEYS).agg(F.max_by("ratio", F.struct("ll", -F.col("ratio"))).alias("ratio"), F.min("ratio").alias("least"))
        best = keep(top.where("least = 0" if step == 0 else "true").drop("least"), "ratio")

    @F.pandas_udf("double")
    def stepped(r: pd.DataFrame) -> pd.Series:
        out = []
        for row in r.itertuples(index=False):
            f = Profile(row, p)
            if row.ratio <= 0:  # leaves the edge if the likelihood rises from it
                out.append(1e-4 if f.slope > 0 else 0.0)
                continue
            to = row.ratio - f.slope / f.bend if f.bend < 0 else row.ratio * (2.0 if f.slope > 0 else 0.5)
            to = min(max(to, row.ratio / 4), row.ratio * 4)
            out.append(to if to > NEGLIGIBLE else 0.0)
        return pd.Series(out, dtype=float)

    told = F.struct("ratio", "n", "m", "h", "yy", "logdet", "m1", "h1", "yy1", "logdet1", "m2", "h2", "yy2", "logdet2")
    for _ in range(POLISH):
        sums = at_ratio(per.join(best, KEYS), p, derivatives=True)
        best = keep(sums.select(*KEYS, stepped(told).alias("ratio")), "ratio")

    @F.pandas_udf("struct<effect:double,standard_error:double,unscaled_se:double,sigma2:double,df:int,denominator_df:double>")
    def finish(r: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in r.itertuples(index=False):
            f = Profile(row, p)
            unit = float(np.sqrt(f.inv[-1, -1]))
            out.append((float(f.beta[-1]), float(np.sqrt(f.sigma2)) * unit, unit, f.sigma2, f.df, f.denominator_df(row.ratio)))
        return pd.DataFrame(out, columns=["effect", "standard_error", "unscaled_se", "sigma2", "df", "denominator_df"])

    sums = keep(at_ratio(per.join(best, KEYS), p, derivatives=True), "solution")
    return sums.select(*KEYS, F.col("n").alias("n_sample_units"), "n_subjects", F.col("ratio").alias("variance_ratio"), finish(told).alias("f")).select(
        *KEYS, "n_sample_units", "n_subjects", "variance_ratio", "f.*")


@F.pandas_udf(DoubleType())
def signed_normal(p: pd.Series, sign: pd.Series) -> pd.Series:
    """The normal deviate of a two-sided p value with the sign given; none at p = 0."""
    point = NormalDist().inv_cdf
    return pd.Series([None if not 0 < v <= 1 else float(-np.sign(s) * point(max(v / 2, 5e-324))) for v, s in zip(p, sign)], dtype=float)


def moderated_mixed_model(fit: DataFrame) -> DataFrame:
    """Adds moderated t, its degrees of freedom, p value and the normal deviate of the same p to ``mixed_model`` 's rows.

    Residual variances are drawn to the type's prior; the test has the effect's denominator degrees of freedom and the prior's.
    """
    j = fit.join(ex.prior_variances(fit), "cell_type")
    post = (F.col("prior_df") * F.col("prior_var") + F.col("df") * F.col("sigma2")) / (F.col("prior_df") + F.col("df"))
    j = j.withColumn("posterior_var", post).withColumn("moderated_t_statistic", F.try_divide("effect", F.col("unscaled_se") * F.sqrt("posterior_var")))
    j = j.withColumn("total_df", F.least(F.col("prior_df") + F.col("denominator_df"), F.lit(1e7)))
    j = j.withColumn("p_value", t_two_sided("moderated_t_statistic", "total_df"))
    return j.withColumn("z_standardized", signed_normal("p_value", "moderated_t_statistic"))


def mixed_scopes(profiles: DataFrame, scopes: DataFrame, min_subjects: int) -> DataFrame:
    """One row per type: its support, and why it has no mixed model.

    ``scopes`` are ``count_models.design_scopes``: a mixed model has no age-only form, so a type that they give one is excluded, as
    is one in which no subject has two sample units.
    """
    per = profiles.groupBy("cell_type", "subject_id").agg(F.count(F.lit(1)).alias("k"))
    seen = per.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_subjects"), F.count_if(F.col("k") > 1).alias("n_subjects_repeated"),
                                        F.max("k").alias("max_samples_per_subject"))
    j = scopes.join(seen, "cell_type")
    narrow = F.col("model_scope") == "age_only_sensitivity"
    reason = F.when(F.col("reason") == "insufficient_replicates", "insufficient_sample_units").when(F.col("reason") != "", F.col("reason")).when(
        F.col("n_subjects") < min_subjects, "insufficient_subjects").when(
        narrow | (F.col("n_subjects_repeated") < 1), "rank_deficient_age_absent_or_no_repeated_subjects").otherwise("")
    j = j.withColumn("reason", reason)
    return j.select(
        "cell_type", F.when(F.col("reason") == "", "adjusted_repeated_measures").otherwise("not_tested").alias("model_scope"),
        F.col("n_replicates").alias("n_sample_units"), "n_subjects", "n_subjects_repeated", "max_samples_per_subject", "age_span_years",
        F.when(F.col("reason") == "", "completed").otherwise("excluded").alias("status"), "reason")


def mixed_gene_models(profiles: DataFrame, sums: DataFrame, covariates: Sequence[str], *, min_sample_units: int = 12, min_subjects: int = 12,
                      min_age_span: float = 12, min_residual_df: int = 5) -> tuple[DataFrame, DataFrame]:
    """Moderated age effect of every kept gene of every type that supports repeated measures, and one row per type about it.

    A type that can't be tested is ``excluded`` with its reason; one of which no gene gets a finite test is ``model_failed``.
    """
    from cohortroll.operators.count_models import design_scopes

    profiles, sums = keep(profiles, "profiles"), keep(sums, "sums")
    scopes, _, _, _ = design_scopes(profiles, covariates, min_replicates=min_sample_units, min_age_span=min_age_span, min_residual_df=min_residual_df)
    about = keep(mixed_scopes(profiles, scopes, min_subjects), "mixed-scopes")
    tested = keep(profiles.join(about.where("status = 'completed'").select("cell_type"), "cell_type", "left_semi"), "tested")
    dense, x, _ = ex.prepare_expression(tested, sums.join(tested.select("profile_id"), "profile_id", "left_semi"), covariates)
    lines, weighted = ex.fixed_model(dense, x)
    fit = keep(mixed_model(weighted, x, "log_cpm", "weight"), "mixed")
    out = keep(moderated_mixed_model(fit), "moderated")
    out = out.join(lines.select(*KEYS, "average_log_cpm"), KEYS).join(about.select("cell_type", "model_scope", "age_span_years"), "cell_type")
    done = out.groupBy("cell_type").agg(F.count("p_value").alias("n_genes_tested"))
    about = about.join(done, "cell_type", "left").fillna(0, ["n_genes_tested"])
    failed = (F.col("status") == "completed") & (F.col("n_genes_tested") == 0)
    about = about.withColumn("reason", F.when(failed, "no_gene_with_a_finite_test").otherwise(F.col("reason"))).withColumn(
        "status", F.when(failed, "model_failed").otherwise(F.col("status")))
    return out.withColumnRenamed("effect", "log2_fc_per_10_years"), about
