"""Per-gene models on pseudobulk counts: filter, normalisation, log-CPM weights and age effects.

Inputs: ``profiles`` (profile_id, cell_type, subject_id, age, sex, batch, library_size) and ``sums``
(profile_id, gene_id, count) with zeros absent. All (type, gene) models are fitted in one plan from
sums; a gene's profiles are never gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortroll.functions.tails import f_upper, t_two_sided
from cohortroll.operators.glm import (
    FOLDED, Z95, fit_folded_counts, fit_grouped, gramian, indicator_columns, pairs, scaled_rank, square, sum_array)
from cohortroll.operators.rollup import wide_quantiles
from cohortroll.operators.stats import age_terms
from cohortroll.session import keep

# Defaults of the design-aware expression filter.
MIN_COUNT, MIN_TOTAL, LARGE_N, MIN_PROP = 10, 15, 10, 0.7


def leverage_sample_size(profiles: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Per type: 1 / largest leverage of the design, shortened above ``LARGE_N``."""
    d, x, _ = indicator_columns(age_terms(profiles, ["cell_type"]), covariates)
    return design_sample_size(d, [*x, "age_decade"])


def design_sample_size(d: DataFrame, x: Sequence[str]) -> DataFrame:
    """The same for profiles that carry their design columns ``x``; columns of zeros take no part."""
    p = len(x)
    gram = gramian(d, ["cell_type"], x)

    @F.pandas_udf("array<double>")
    def inverse(g: pd.Series) -> pd.Series:
        return pd.Series([list(np.linalg.pinv(square(np.asarray(v, float), p), rcond=1e-10).ravel()) for v in g])

    # One row per type, written so Spark knows it: profiles aren't dealt by type, a task for each, to meet it.
    inv = keep(gram.select("cell_type", inverse("gram").alias("inv")), "inverses")
    lev = F.expr(" + ".join(f"inv[{i * p + j}] * `{x[i]}` * `{x[j]}`" for i in range(p) for j in range(p)))
    n = F.try_divide(F.lit(1.0), F.max(lev))
    return d.join(inv, "cell_type").groupBy("cell_type").agg(n.alias("n0")).select(
        "cell_type", F.when(F.col("n0") > LARGE_N, LARGE_N + (F.col("n0") - LARGE_N) * MIN_PROP)
        .otherwise(F.col("n0")).alias("min_samples"))


def expressed_genes(profiles: DataFrame, sums: DataFrame, min_samples: DataFrame) -> DataFrame:
    """Genes above the CPM cut-off in enough profiles and above the least total, per type."""
    lib = wide_quantiles(profiles, ["cell_type"], "library_size", {"median_lib": 0.5})
    # One row per type, written so Spark knows it: counts aren't dealt by type, a task for each, to meet them.
    cut = keep(lib.join(min_samples, "cell_type").withColumn("cutoff", MIN_COUNT / F.col("median_lib") * 1e6), "cutoffs")
    j = sums.join(profiles.select("profile_id", "cell_type", "library_size"), "profile_id").join(cut, "cell_type")
    cpm = F.col("count") * 1e6 / F.col("library_size")
    return j.groupBy("cell_type", "gene_id", "min_samples").agg(
        F.count_if(cpm >= F.col("cutoff")).alias("n_above"), F.sum("count").alias("total")).where(
        (F.col("n_above") >= F.col("min_samples") - 1e-14) & (F.col("total") >= MIN_TOTAL)).drop("min_samples")


def tmm_factors(profiles: DataFrame, sums: DataFrame, trim_ratio: float = 0.3, trim_level: float = 0.05) -> DataFrame:
    """Trimmed-mean scaling factors per profile within its type, with geometric mean one.

    The reference profile has the upper quartile (over genes seen in the type, zeros included) nearest
    to the type's mean upper quartile. Ranks run over genes of one profile.
    """
    lib = profiles.select("profile_id", "cell_type", "library_size")
    s = keep(sums.join(lib, "profile_id").where("library_size > 0"), "typed-sums")
    genes = s.groupBy("cell_type").agg(F.count_distinct("gene_id").alias("g"))
    seen = s.groupBy("profile_id", "cell_type", "library_size", "count").agg(F.count(F.lit(1)).alias("n"))
    zeros = seen.groupBy("profile_id", "cell_type", "library_size").agg(F.sum("n").alias("k")).join(genes, "cell_type").select(
        "profile_id", "cell_type", "library_size", F.lit(0).cast("bigint").alias("count"), (F.col("g") - F.col("k")).alias("n"))
    quart = seen.unionByName(zeros.where("n > 0")).groupBy("profile_id", "cell_type", "library_size").agg(
        F.percentile("count", F.lit(0.75), F.col("n")).alias("q")).withColumn("q", F.col("q") / F.col("library_size"))
    # What several steps read is written once, and what is few is known to be: counts don't move to meet it.
    quart = keep(quart, "quartiles")
    mean = quart.groupBy("cell_type").agg(F.avg("q").alias("m"))
    ref = quart.join(mean, "cell_type").groupBy("cell_type").agg(
        F.min(F.struct(F.round(F.abs(F.col("q") - F.col("m")), 12).alias("d"), "profile_id")).alias("r")).select(
        "cell_type", F.col("r.profile_id").alias("ref"))
    ref_counts = keep(s.join(keep(ref, "references"), "cell_type").where("profile_id = ref").select(
        "cell_type", "gene_id", F.col("count").alias("rc"), F.col("library_size").alias("rl")), "reference-counts")
    j = s.join(ref_counts, ["cell_type", "gene_id"])
    a, b = F.col("count") / F.col("library_size"), F.col("rc") / F.col("rl")
    j = j.select(
        "cell_type", "profile_id", F.round(F.log2(a / b), 12).alias("m"), F.round((F.log2(a) + F.log2(b)) / 2, 12).alias("a"),
        ((F.col("library_size") - F.col("count")) / F.col("library_size") / F.col("count")
         + (F.col("rl") - F.col("rc")) / F.col("rl") / F.col("rc")).alias("v"))
    w = Window.partitionBy("profile_id")

    def mean_rank(value):
        alike = F.count(F.lit(1)).over(w.orderBy(value).rangeBetween(Window.currentRow, Window.currentRow))
        return F.rank().over(w.orderBy(value)) + (alike - 1) / 2.0

    j = j.withColumns({"n": F.count(F.lit(1)).over(w), "rm": mean_rank("m"), "ra": mean_rank("a")})

    def inside(rank, trim):
        low = F.floor(F.col("n") * trim) + 1
        return (F.col(rank) >= low) & (F.col(rank) <= F.col("n") + 1 - low)

    used = inside("rm", trim_ratio) & inside("ra", trim_level) & (F.col("v") > 0)
    f = j.groupBy("cell_type", "profile_id").agg(
        F.coalesce(F.try_divide(F.sum(F.when(used, F.col("m") / F.col("v"))), F.sum(F.when(used, 1 / F.col("v")))),
                   F.lit(0.0)).alias("lf"))
    f = keep(lib.join(f, ["profile_id", "cell_type"], "left").fillna(0.0, ["lf"]), "factors")
    centre = f.groupBy("cell_type").agg(F.avg("lf").alias("c"))
    return f.join(centre, "cell_type").select(
        "profile_id", "cell_type", "library_size", F.pow(F.lit(2.0), F.col("lf") - F.col("c")).alias("norm_factor"))


def dense_counts(profiles: DataFrame, sums: DataFrame, genes: DataFrame) -> DataFrame:
    """Every profile with every kept gene of its type; absent counts are 0. The gene list per type is
    bounded by the gene catalogue and unfolds on the map side, so a large type is not a hot key."""
    listed = genes.groupBy("cell_type").agg(F.collect_list("gene_id").alias("genes"))
    # Only counts are shuffled, one list a profile; the grid unfolds after that.
    known = sums.join(profiles.select("profile_id", "cell_type"), "profile_id").join(
        genes.select("cell_type", "gene_id").distinct(), ["cell_type", "gene_id"], "left_semi")
    packed = known.groupBy("profile_id").agg(F.collect_list(F.struct("gene_id", F.coalesce("count", F.lit(0)).alias("count"))).alias("__seen"))
    zero = F.lit(0).cast(packed.schema["__seen"].dataType.elementType["count"].dataType)
    seen = F.coalesce("__seen", F.array().cast(packed.schema["__seen"].dataType))
    absent = F.transform(F.array_except("genes", F.transform(seen, lambda s: s["gene_id"])), lambda g: F.struct(g.alias("gene_id"), zero.alias("count")))
    grid = profiles.join(listed, "cell_type").join(packed, "profile_id", "left")
    return grid.select(*profiles.columns, F.inline(F.concat(seen, absent)))


def log_cpm(dense: DataFrame) -> DataFrame:
    size = F.col("library_size") * F.coalesce(F.col("norm_factor"), F.lit(1.0)) + 1
    return dense.withColumn("log_cpm", F.log2((F.col("count") + 0.5) / size * 1e6)).withColumn("log_size", F.log2(size))


def lowess(x: np.ndarray, y: np.ndarray, f: float = 0.5, rounds: int = 3, points: int = 200) -> np.ndarray:
    """Locally weighted lines with robustness rounds, at up to ``points`` spots, joined linearly."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    n, k = len(xs), max(int(np.ceil(f * len(xs))), 2)
    spots = np.unique(np.linspace(0, n - 1, min(points, n)).round().astype(int))
    robust, fitted = np.ones(n), ys.copy()
    for _ in range(rounds + 1):
        values = []
        for i in spots:
            lo = min(max(np.searchsorted(xs, xs[i]) - k // 2, 0), n - k)
            while lo > 0 and xs[i] - xs[lo - 1] < xs[lo + k - 1] - xs[i]:
                lo -= 1
            while lo + k < n and xs[lo + k] - xs[i] < xs[i] - xs[lo]:
                lo += 1
            u, v, r = xs[lo:lo + k], ys[lo:lo + k], robust[lo:lo + k]
            h = max(np.abs(u - xs[i]).max(), 1e-12) * 1.0001
            w = (1 - (np.abs(u - xs[i]) / h) ** 3) ** 3 * r
            sw = w.sum()
            if sw <= 0:
                values.append(fitted[i])
                continue
            mu, mv = (w * u).sum() / sw, (w * v).sum() / sw
            sxx = (w * (u - mu) ** 2).sum()
            slope = (w * (u - mu) * (v - mv)).sum() / sxx if sxx > 1e-12 * sw else 0.0
            values.append(mv + slope * (xs[i] - mu))
        fitted = np.interp(xs, xs[spots], values)
        resid = np.abs(ys - fitted)
        scale = 6 * np.median(resid)
        if scale < 1e-12:
            break
        robust = np.where(resid < scale, (1 - (resid / scale) ** 2) ** 2, 0)
    out = np.empty(n)
    out[order] = fitted
    return out


def gene_lines(dense: DataFrame, x: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(Weighted) least squares per (type, gene) with residual variance, from sums."""
    keys, p = ["cell_type", "gene_id"], len(x)
    w = f"`{weight}` * " if weight else ""
    s = dense.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), sum_array(f"{w}`{x[i]}` * `{x[j]}`" for i, j in pairs(p)).alias("g"),
        sum_array(f"{w}`{c}` * `{value}`" for c in x).alias("h"), F.expr(f"sum({w}`{value}` * `{value}`)").alias("yy"),
        F.avg(value).alias("average_log_cpm"), F.avg("log_size").alias("mean_log_size"))

    @F.pandas_udf("struct<beta:array<double>,unscaled_se:double,sigma2:double,df:int,estimable:boolean>")
    def solve(g: pd.Series, h: pd.Series, yy: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for gi, hi, y2, ni in zip(g, h, yy, n):
            m, v = square(np.asarray(gi, float), p), np.asarray(hi, float)
            inv = np.linalg.pinv(m, rcond=1e-11)
            beta = inv @ v
            rank = scaled_rank(m)
            left = int(ni) - rank
            sigma2 = max(float(y2 - beta @ v), 0.0) / left if left > 0 else None
            out.append((list(beta), float(np.sqrt(max(inv[-1, -1], 0))), sigma2, left, bool(left > 0)))
        return pd.DataFrame(out, columns=["beta", "unscaled_se", "sigma2", "df", "estimable"])

    return s.withColumn("f", solve("g", "h", "yy", "n")).select(
        *keys, "n", "average_log_cpm", "mean_log_size", F.col("f.beta")[p - 1].alias("effect"), "f.*")


def voom_trend(lines: DataFrame) -> DataFrame:
    """Smoothed root standard deviation against mean log count per type, as a knot table.

    One row per gene of a type meets in one call; that is bounded by the gene catalogue.
    """
    rows = lines.where("sigma2 is not null").select(
        "cell_type", (F.col("average_log_cpm") + F.col("mean_log_size") - F.log2(F.lit(1e6))).alias("sx"),
        F.pow("sigma2", F.lit(0.25)).alias("sy"))

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["sx"].to_numpy(float), pdf["sy"].to_numpy(float)
        fit = lowess(x, y) if len(x) > 2 else np.full(len(x), y.mean())
        order = np.argsort(x, kind="stable")
        at = np.unique(np.linspace(0, len(x) - 1, min(len(x), 200)).round().astype(int))
        return pd.DataFrame({"cell_type": [pdf["cell_type"].iloc[0]], "knots": [list(x[order][at])],
                             "levels": [list(np.maximum(fit[order][at], 1e-6))]})

    return rows.groupBy("cell_type").applyInPandas(smooth, "cell_type string, knots array<double>, levels array<double>")


def precision_weights(dense: DataFrame, lines: DataFrame, trend: DataFrame, x: Sequence[str]) -> DataFrame:
    """Weight of each observation from the trend at its fitted log count."""
    fitted = F.expr(" + ".join(f"beta[{i}] * `{c}`" for i, c in enumerate(x)))
    j = dense.join(lines.select("cell_type", "gene_id", "beta"), ["cell_type", "gene_id"])
    # At most 200 knots a type; they go to the tasks once, not beside each row.
    curves = {r["cell_type"]: (np.array(r["knots"], float), np.array(r["levels"], float)) for r in trend.collect()}
    j = j.where(F.col("cell_type").isin(list(curves)))

    @F.pandas_udf("double")
    def at(v: pd.Series, cell_type: pd.Series) -> pd.Series:
        out = np.empty(len(v))
        for name, idx in cell_type.groupby(cell_type).indices.items():
            out[idx] = np.interp(v.to_numpy(float)[idx], *curves[name])
        return pd.Series(1 / out ** 4)

    return j.withColumn("weight", at(fitted + F.col("log_size") - F.log2(F.lit(1e6)), "cell_type")).drop("beta")


def _trigamma_inverse(v: float) -> float:
    y = 0.5 + 1 / v
    for _ in range(60):
        t = _polygamma(1, y)
        step = t * (1 - t / v) / _polygamma(2, y)
        y += step
        if abs(step) < 1e-10 * y:
            break
    return y


def _polygamma(order: int, x: float) -> float:
    """digamma (0), trigamma (1) and its derivative (2): recurrence up to 12, then the series."""
    shift = 0.0
    while x < 12:
        shift += {0: -1 / x, 1: 1 / x**2, 2: -2 / x**3}[order]
        x += 1
    i = 1 / x
    series = {
        0: np.log(x) - i / 2 - i**2 / 12 + i**4 / 120 - i**6 / 252,
        1: i + i**2 / 2 + i**3 / 6 - i**5 / 30 + i**7 / 42,
        2: -(i**2) - i**3 - i**4 / 2 + i**6 / 6 - i**8 / 6,
    }[order]
    return float(shift + series)


def prior_variances(lines: DataFrame) -> DataFrame:
    """Prior variance and df of each type from the moments of the log variances ``sigma2`` with ``df``."""
    v = lines.where("sigma2 > 0 and df > 0")
    z = v.groupBy("cell_type", "df").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.log("sigma2")).alias("z1"), F.sum(F.log("sigma2") * F.log("sigma2")).alias("z2"))
    rows = z.groupBy("cell_type").agg(F.collect_list(F.struct("df", "n", "z1", "z2")).alias("m"))

    @F.pandas_udf("struct<prior_df:double,prior_var:double>")
    def prior(m: pd.Series) -> pd.DataFrame:
        out = []
        for groups in m:
            n = sum(g["n"] for g in groups)
            s1 = s2 = tri = 0.0
            for g in groups:
                shift = -_polygamma(0, g["df"] / 2) + np.log(g["df"] / 2)
                s1 += g["z1"] + g["n"] * shift
                s2 += g["z2"] + 2 * shift * g["z1"] + g["n"] * shift**2
                tri += g["n"] * _polygamma(1, g["df"] / 2)
            mean = s1 / n
            extra = (s2 - n * mean**2) / max(n - 1, 1) - tri / n
            if n > 1 and extra > 1e-12:
                d0 = 2 * _trigamma_inverse(extra)
                out.append((d0, float(np.exp(mean + _polygamma(0, d0 / 2) - np.log(d0 / 2)))))
            else:
                out.append((1e10, float(np.exp(mean))))
        return pd.DataFrame(out, columns=["prior_df", "prior_var"])

    return rows.select("cell_type", prior("m").alias("p")).select("cell_type", "p.*")


def moderate(lines: DataFrame) -> DataFrame:
    """Empirical-Bayes moderated t by the prior of each type."""
    j = lines.join(prior_variances(lines), "cell_type")
    post = (F.col("prior_df") * F.col("prior_var") + F.col("df") * F.col("sigma2")) / (F.col("prior_df") + F.col("df"))
    j = j.withColumn("post_var", post).withColumn(
        "moderated_t", F.try_divide("effect", F.col("unscaled_se") * F.sqrt("post_var")))
    return j.withColumn("p_value", t_two_sided("moderated_t", F.least(F.col("prior_df") + F.col("df"), F.lit(1e7))))


def kept_libraries(profiles: DataFrame, sums: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles and counts after the gene filter of each cell type.

    A gene counts only in the types that keep it, and a library is the sum of its kept counts. Profiles
    that are left without a count drop out.
    """
    typed = sums.join(profiles.select("profile_id", "cell_type"), "profile_id")
    kept = typed.join(genes.select("cell_type", "gene_id"), ["cell_type", "gene_id"], "left_semi").select(*sums.columns)
    library = kept.groupBy("profile_id").agg(F.sum("count").alias("library_size")).where("library_size > 0")
    return profiles.drop("library_size").join(library, "profile_id"), kept


def prepare_counts(profiles: DataFrame, sums: DataFrame, covariates: Sequence[str]):
    """Profiles with their scaling factors and design columns, the last of which is age per decade, and the kept counts and genes."""
    profiles, sums = keep(profiles, "profiles"), keep(sums, "sums")
    genes = keep(expressed_genes(profiles, sums, leverage_sample_size(profiles, covariates)), "genes")
    profiles, sums = kept_libraries(profiles, sums, genes)
    profiles, sums = keep(profiles, "profiles"), keep(sums, "sums")
    factors = tmm_factors(profiles, sums)
    ready = profiles.join(factors.select("profile_id", "norm_factor"), "profile_id")
    d, x, groups = indicator_columns(age_terms(ready, ["cell_type"]), covariates)
    return d, sums, genes, [*x, "age_decade"], groups


def prepare_expression(profiles: DataFrame, sums: DataFrame, covariates: Sequence[str]):
    """Filtered, normalised and dense log-CPM with the design columns; the last is age per decade."""
    d, sums, genes, x, groups = prepare_counts(profiles, sums, covariates)
    dense = keep(log_cpm(dense_counts(d, sums, genes)), "dense")
    return dense, x, groups


def fixed_model(dense: DataFrame, x: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Precision-weighted lines with moderated t per gene; also returns the weighted rows."""
    lines = keep(gene_lines(dense, x, "log_cpm"), "lines")
    weighted = keep(precision_weights(dense, lines, voom_trend(lines), x), "weighted")
    fit = keep(gene_lines(weighted, x, "log_cpm", "weight"), "weighted_lines")
    return moderate(fit), weighted


def quasi_poisson(dense: DataFrame, keys: Sequence[str], x: Sequence[str], groups) -> DataFrame:
    """Log-linear model per gene with log library offset and a free dispersion; F test on age."""
    rows = dense.withColumn("offset", F.log(F.col("library_size") * F.col("norm_factor")))
    fit = fit_grouped(rows, keys, "count", x, ["profile_id"], family="poisson", offset="offset", groups=groups, max_iter=25, single=True)
    return age_tests(fit, keys, len(x) - 1)


def age_tests(fit: DataFrame, keys: Sequence[str], i: int) -> DataFrame:
    """Dispersion and F test of column ``i``, age, of quasi-Poisson fits."""
    done = F.col("status") == "completed"
    # The variance here is dispersion times inverse information, not the sandwich.
    f = F.try_divide(F.pow(F.col("at_beta")[i], F.lit(2.0)), F.pow(F.col("naive_se")[i], F.lit(2.0)))
    out = fit.select(
        *keys, "status", "n_observations", F.when(done, F.col("at_beta")[i] / F.log(F.lit(2.0))).alias("log2_fc_per_10_years"),
        F.when(done, F.col("phi")).alias("dispersion"), F.when(done, f).alias("f_statistic"),
        (F.col("n_observations") - F.col("rank")).alias("residual_df"))
    return out.withColumn("p_value", f_upper("f_statistic", F.lit(1.0), F.col("residual_df").cast("double")))


def robustness_scenarios(rows: DataFrame, high_cells: int, profiles: DataFrame | None = None) -> DataFrame:
    """Each row under each scenario that keeps its profile: high cell support, one covariate dropped, each
    batch left out. ``use_sex`` and ``use_batch`` say which covariates the scenario's model has.

    Rows are profiles, or rows that carry their profile's ``batch`` and ``n_cells``; then ``profiles`` has all batches. They
    unfold where they are: a table of every profile under every scenario is never joined, so never broadcast either.

    The result has a row per row and batch, so the list of all batches, a scalar subquery, is never
    longer than what one profile unfolds to. A profile without a batch is in no scenario.
    """
    def scenario(name, kind, sex, batch, excluded):
        return F.struct(name.alias("scenario_id"), F.lit(kind).alias("scenario_type"), F.lit(sex).alias("use_sex"),
                        F.lit(batch).alias("use_batch"), excluded.alias("excluded_batch"))

    fixed = F.array(*[scenario(F.lit(name), kind, sex, batch, F.lit("")) for name, kind, sex, batch in (
        ("high_cell_support", "cell_support", True, True), ("drop_sex", "covariate", False, True), ("drop_batch", "covariate", True, False))])
    batches = (rows if profiles is None else profiles).agg(F.array_sort(F.collect_set(F.col("batch").cast("string"))).alias("b")).scalar()
    left_out = F.transform("__batches", lambda v: scenario(F.concat(F.lit("leave_out_"), v), "leave_one_batch_out", True, True, v))
    unfolded = rows.withColumn("__batches", batches).select(*rows.columns, F.inline(F.concat(fixed, left_out)))
    return unfolded.where((F.col("scenario_id") != "high_cell_support") | (F.col("n_cells") >= high_cells)).where(
        F.col("batch") != F.col("excluded_batch"))


def folded_counts(d: DataFrame, sums: DataFrame, genes: DataFrame, x: Sequence[str], high_cells: int) -> DataFrame:
    """Every kept gene of a type with every design among the type's profiles, as the sums that ``fit_folded_counts`` takes.

    A design is the covariate columns ``x`` without age per decade, the age, the batch and whether ``n_cells`` reaches ``high_cells``,
    which is all that ``n_cells`` still tells. Profiles fold before genes unfold, so the grid of profiles and genes is never made: absent
    counts only add exposure.
    """
    design = ["cell_type", *x[:-1], "age", "batch", "n_cells"]
    cells = F.when(F.col("n_cells") >= high_cells, high_cells).when(F.col("n_cells") < high_cells, high_cells - 1)
    d = keep(d.select("profile_id", *design[:-1], cells.alias("n_cells"), (F.col("library_size") * F.col("norm_factor")).alias("__e")), "design")
    e, y, none = F.col("__e"), F.col("count"), F.lit(0.0)
    listed = genes.groupBy("cell_type").agg(F.collect_list("gene_id").alias("__genes"))
    exposed = d.groupBy(*design).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("__e").alias("e"), F.sum(e * e).alias("ee"))
    exposed = exposed.join(listed, "cell_type").select(*design, F.explode("__genes").alias("gene_id"), "n", "e", "ee", *[none.alias(c) for c in FOLDED[3:]])
    counted = sums.where("count > 0").join(d.select("profile_id", *design, "__e"), "profile_id").groupBy(*design, "gene_id").agg(
        *[F.sum(v.cast("double")).alias(c) for c, v in zip(FOLDED[3:], (y, y.cast("double") * y, y * e, y.cast("double") * y / e))])
    counted = counted.select(*design, "gene_id", *[none.alias(c) for c in FOLDED[:3]], *FOLDED[3:])
    return keep(exposed.unionByName(counted).groupBy(*design, "gene_id").agg(*[F.sum(c).alias(c) for c in FOLDED]), "designs")


def folded_quasi_poisson(folded: DataFrame, keys: Sequence[str], x: Sequence[str], groups) -> DataFrame:
    """``quasi_poisson`` of ``folded_counts``; age is centred inside each model."""
    n = F.when(F.col("age").isNotNull(), F.col("n"))
    means = keep(folded.groupBy(*keys).agg(F.try_divide(F.sum(n * F.col("age")), F.sum(n)).alias("__mean_age")), "mean-age")
    rows = folded.join(means, list(keys)).withColumn("age_decade", (F.col("age") - F.col("__mean_age")) / 10)
    return age_tests(fit_folded_counts(rows, keys, x, groups, max_iter=25), keys, len(x) - 1)


def scenario_models(folded: DataFrame, profiles: DataFrame, high_cells: int, candidates: DataFrame, x: Sequence[str], groups,
                    sex_columns: Sequence[str], batch_columns: Sequence[str]) -> DataFrame:
    """Quasi-Poisson refits of candidates only, every scenario in one grouped fit of ``folded_counts``.

    Dropped covariates become zero columns, which the solver leaves out, so all scenarios share one
    design. A scenario that cannot be estimated is a status, not a failure.
    """
    rows = folded.join(candidates.select("cell_type", "gene_id"), ["cell_type", "gene_id"], "left_semi")
    rows = robustness_scenarios(rows, high_cells, profiles)
    rows = rows.withColumns({c: F.when(F.col("use_sex"), F.col(c)).otherwise(0.0) for c in sex_columns})
    rows = rows.withColumns({c: F.when(F.col("use_batch"), F.col(c)).otherwise(0.0) for c in batch_columns})
    return folded_quasi_poisson(rows, ["cell_type", "gene_id", "scenario_id"], x, groups)


def effect_interval(df: DataFrame) -> DataFrame:
    return df.withColumns({"ci_low": F.col("log2_fc_per_10_years") - Z95 * F.col("standard_error"),
                           "ci_high": F.col("log2_fc_per_10_years") + Z95 * F.col("standard_error")})
