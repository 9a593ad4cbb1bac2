"""Subject-grouped prediction of age from latent vectors.

Ridge models need only sums of products. One pass gives them per (outer fold, inner fold) block;
every training set, penalty and nested split is then a sum of blocks, so no model re-reads the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortroll.functions.scalar import hash_int
from cohortroll.operators.glm import square
from cohortroll.operators.sampling import cluster_bootstrap, grouped_folds, mean_bootstrap
from cohortroll.operators.stats import prediction_metrics
from cohortroll.session import keep

ALPHAS = (0.1, 1.0, 10.0, 100.0)  # fixed values: the default penalty grid


def with_folds(rows: DataFrame, subject: str, outer: int, inner: int) -> DataFrame:
    """Outer and inner test fold per row, both grouped by subject. Inner folds deal the subjects out
    in a different order, so that every outer training set meets every inner fold."""
    folds = grouped_folds(rows, subject, outer).withColumnRenamed("fold", "outer_fold")
    folds = folds.withColumn("inner_fold", F.pmod(hash_int(F.lit("inner"), subject), F.lit(inner)).cast("int"))
    return rows.join(folds.withColumnRenamed("n_rows", "subject_rows"), subject)


def training_baseline(rows: DataFrame, subject: str, age: str = "age") -> DataFrame:
    """Per outer fold: mean over training subjects of their median age."""
    med = rows.groupBy(subject, "outer_fold", age).agg(F.count(F.lit(1)).alias("n")).groupBy(
        subject, "outer_fold").agg(F.percentile(age, F.lit(0.5), F.col("n")).alias("m"))
    per = med.groupBy("outer_fold").agg(F.sum("m").alias("s"), F.count(F.lit(1)).alias("k"))
    every = per.agg(F.struct(F.sum("s").alias("s"), F.sum("k").alias("k")).alias("t")).scalar()
    return per.withColumn("t", every).select("outer_fold", F.try_divide(
        F.col("t.s") - F.col("s"), (F.col("t.k") - F.col("k")).cast("double")).alias("age_base"))


def _block_sums(rows: DataFrame, types: Sequence[str], width: int) -> DataFrame:
    """Sums of products per block in long form (outer_fold, inner_fold, pos, v)."""
    kinds = {t: i for i, t in enumerate(types)}
    p = 1 + width + len(types) + 1
    iu = np.triu_indices(p)

    def reduce_batches(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.stack(pdf["vec"].to_numpy()).astype(float)
            hot = np.zeros((len(pdf), len(kinds)))
            hot[np.arange(len(pdf)), pdf["cell_type"].map(kinds).to_numpy()] = 1
            y = pdf["age"].to_numpy(float)
            m = np.column_stack([np.ones(len(pdf)), z, hot, y])
            w = 1 / pdf["subject_rows"].to_numpy(float)
            for (o, i), at in pdf.groupby(["outer_fold", "inner_fold"]).indices.items():
                a = m[at]
                gram = (a * w[at][:, None]).T @ a
                yield pd.DataFrame({"outer_fold": [o], "inner_fold": [i], "lo": [y[at].min()], "hi": [y[at].max()],
                                    "v": [np.r_[gram[iu], a.sum(0), (a * a).sum(0)]]})

    cols = rows.select("outer_fold", "inner_fold", "subject_rows", F.col("cell_type").cast("string"), "age", "vec")
    return cols.mapInPandas(reduce_batches, "outer_fold int, inner_fold int, lo double, hi double, v array<double>")


def ridge_fits(rows: DataFrame, types: Sequence[str], width: int, outer: int, inner: int,
               alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Coefficients for every (outer fold, inner fold or -1, alpha) on its own training rows.

    Numerics are scaled by training mean and population deviation, types are one-hot, rows weigh
    1 / rows of their subject at mean one, and the intercept is not penalised.
    """
    p = 1 + width + len(types) + 1
    blocks = _block_sums(rows, types, width)
    fits = [(o, i) for o in range(outer) for i in (-1, *range(inner))]
    listed = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(i).alias("i")) for o, i in fits])
    used = F.filter(listed, lambda f: (f["o"] != F.col("outer_fold")) & (f["i"] != F.col("inner_fold")))
    train = blocks.select("lo", "hi", "v", F.inline(used))
    span = train.groupBy("o", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    long = train.select("o", "i", F.posexplode("v").alias("pos", "x")).groupBy("o", "i", "pos").agg(F.sum("x").alias("x"))
    packed = long.groupBy("o", "i").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v")).join(span, ["o", "i"])
    packed = packed.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    k = p * (p + 1) // 2

    @F.pandas_udf("struct<intercept:double,coef:array<double>,type_coef:array<double>>")
    def solve(v: pd.Series, alpha: pd.Series) -> pd.DataFrame:
        out = []
        for vi, a in zip(v, alpha):
            vi = np.asarray(vi, float)
            g, s1, s2 = square(vi[:k], p), vi[k:k + p], vi[k + p:]
            n, wsum = s1[0], g[0, 0]
            g = g * (n / wsum)  # weights at mean one
            mean, sd = s1[1:1 + width] / n, np.sqrt(np.maximum(s2[1:1 + width] / n - (s1[1:1 + width] / n) ** 2, 0))
            sd = np.where(sd > 1e-12, sd, 1.0)
            # columns: scaled numerics and indicators, centred by weighted means
            t = np.eye(p)
            t[0, 1:1 + width] = -mean / sd
            t[np.arange(1, 1 + width), np.arange(1, 1 + width)] = 1 / sd
            h = t.T @ g @ t
            centred = h - np.outer(h[0], h[0]) / h[0, 0]
            x, y = centred[1:-1, 1:-1], centred[1:-1, -1]
            beta = np.linalg.solve(x + a * np.eye(len(x)), y)
            level = (h[0, -1] - beta @ h[0, 1:-1]) / h[0, 0]
            coef = beta[:width] / sd
            out.append((float(level - coef @ mean), list(coef), list(beta[width:])))
        return pd.DataFrame(out, columns=["intercept", "coef", "type_coef"])

    return packed.withColumn("fit", solve("v", "alpha")).select(
        F.col("o").alias("fit_outer"), F.col("i").alias("fit_inner"), "alpha", "lo", "hi", "fit.*")


def ridge_predictions(rows: DataFrame, fits: DataFrame, types: Sequence[str], clip: bool = True) -> DataFrame:
    """Predictions of every fit on the rows it was not trained on (``fit_inner`` -1: outer test)."""
    outer = (F.col("fit_inner") == -1) & (F.col("outer_fold") == F.col("fit_outer"))
    inner = (F.col("fit_inner") == F.col("inner_fold")) & (F.col("outer_fold") != F.col("fit_outer"))
    # Key the join by the test fold so each row meets only the fits that hold it out.
    n_outer = fits.agg((F.max("fit_outer") + 1).alias("n")).scalar()
    held = rows.withColumn("n", n_outer).withColumn("pairs", F.concat(
        F.array(F.struct(F.col("outer_fold").alias("fit_outer"), F.lit(-1).alias("fit_inner"))),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda o: o != F.col("outer_fold")),
                    lambda o: F.struct(o.alias("fit_outer"), F.col("inner_fold").alias("fit_inner")))))
    held = held.select(*[c for c in rows.columns], F.inline("pairs"))
    j = held.join(fits, ["fit_outer", "fit_inner"]).where(outer | inner)
    at = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("cell_type").cast("string")).cast("int")
    dot = F.aggregate(F.zip_with(F.col("vec"), F.col("coef"), lambda a, b: a.cast("double") * b),
                      F.lit(0.0), lambda acc, v: acc + v)
    raw = F.col("intercept") + dot + F.coalesce(F.try_element_at("type_coef", at), F.lit(0.0))
    pred = F.greatest(F.col("lo"), F.least(F.col("hi"), raw)) if clip else raw
    return j.withColumn("age_pred", pred).drop("coef", "type_coef", "intercept", "lo", "hi", "vec")


def nested_ridge(rows: DataFrame, subject: str, outer: int = 5, inner: int = 3, alphas=ALPHAS, max_types: int = 1000):
    """Candidate predictions for each alpha, plus the nested model that picks its alpha per outer
    fold by inner error. Input: subject, sample_unit_id, cell_type, age, vec (one row per profile)."""
    rows = keep(with_folds(rows, subject, outer, inner), "folds")
    first = rows.agg(F.max(F.size("vec")).alias("w"), F.count_distinct("cell_type").alias("n")).first()
    if first["n"] > max_types:
        raise ValueError(f"{first['n']} types are too many for one-hot columns")
    width = first["w"]
    types = list(rows.agg(F.array_sort(F.collect_set(F.col("cell_type").cast("string")))).first()[0])
    fits = keep(ridge_fits(rows, types, width, outer, inner, alphas), "fits")
    preds = keep(ridge_predictions(rows, fits, types), "predictions")
    err = preds.where("fit_inner >= 0").groupBy("fit_outer", "alpha").agg(
        F.avg(F.abs(F.col("age") - F.col("age_pred"))).alias("mae"))
    best = err.groupBy("fit_outer").agg(F.min(F.struct("mae", "alpha")).alias("b")).select(
        "fit_outer", F.col("b.alpha").alias("alpha"))
    held = preds.where("fit_inner = -1")
    named = held.withColumn("model", F.format_string("ridge_alpha_%s", F.col("alpha").cast("string")))
    nested = held.join(best, ["fit_outer", "alpha"]).withColumn("model", F.lit("nested_ridge"))
    both = named.unionByName(nested)
    return both.join(training_baseline(rows, subject), "outer_fold")


def gbt_predictions(rows: DataFrame, subject: str, folds: int, seed: int, **params) -> DataFrame:
    """Boosted-tree candidate with the same grouped folds; one distributed fit per fold."""
    rows = keep(with_folds(rows, subject, folds, 1).withColumn("z", array_to_vector("vec")).withColumn(
        "kind", F.col("cell_type").cast("string")).withColumn("w", 1 / F.col("subject_rows")), "folds")
    out = None
    for fold in range(folds):
        train, test = rows.where(F.col("outer_fold") != fold), rows.where(F.col("outer_fold") == fold)
        pipe = Pipeline(stages=[
            StringIndexer(inputCol="kind", outputCol="ki", handleInvalid="keep"),
            OneHotEncoder(inputCols=["ki"], outputCols=["kh"], dropLast=False, handleInvalid="keep"),
            VectorAssembler(inputCols=["z", "kh"], outputCol="features"),
            GBTRegressor(labelCol="age", featuresCol="features", weightCol="w", seed=seed, **params)])
        span = train.agg(F.struct(F.min("age").alias("lo"), F.max("age").alias("hi")).alias("s")).scalar()
        part = pipe.fit(train).transform(test).withColumn("s", span).withColumn(
            "age_pred", F.greatest(F.col("s.lo"), F.least(F.col("s.hi"), F.col("prediction"))))
        part = part.select(subject, "sample_unit_id", "cell_type", "age", "outer_fold", "age_pred", F.lit("gbt").alias("model"))
        out = part if out is None else out.unionByName(part)
    return out.join(training_baseline(rows, subject), "outer_fold")


def prediction_frame(preds: DataFrame, within: float = 5.0) -> DataFrame:
    e = F.col("age_pred") - F.col("age")
    return preds.withColumns({"residual": e, "abs_error": F.abs(e), "within_5y": F.abs(e) <= within})


def roll_to_sample(preds: DataFrame, keys: Sequence[str], size: str = "n_cells") -> DataFrame:
    """Cell-weighted mean prediction and baseline per sample (plain mean when weights sum to 0),
    median truth."""
    w = F.sum(size)

    def weighted(col):
        return F.coalesce(F.try_divide(F.sum(F.col(col) * F.col(size)), w.cast("double")), F.avg(col))

    main = preds.groupBy(*keys).agg(
        weighted("age_pred").alias("age_pred"), weighted("age_base").alias("age_base"),
        w.alias("n_cells"), F.count(F.lit(1)).alias("n_groups"))
    med = preds.groupBy(*keys, "age").agg(F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(
        F.percentile("age", F.lit(0.5), F.col("k")).alias("age"))
    return main.join(med, list(keys))


def model_table(preds: DataFrame, subject: str, n_boot: int, ci: float, seed: int) -> DataFrame:
    """Metrics with subject-bootstrap intervals per model, best flags and the gap to the best ridge."""
    m = prediction_metrics(preds, ["model"], "age", "age_pred", "age_base")
    ci_table = cluster_bootstrap(preds, subject, "age", "age_pred", n_boot, ci, seed, ["model"])
    m = keep(m.join(ci_table, "model"), "metrics")
    nested = F.col("model").startswith("nested")
    ridge = F.col("model").startswith("ridge")
    # The nested model wins when there is one; ties go to the first name.
    best = m.agg(F.min(F.struct((~nested).alias("a"), F.col("mae").alias("b"), F.col("model").alias("c")))["c"].alias("m")).scalar()
    best_ridge = m.where(ridge).agg(F.min(F.struct("mae", "model"))["model"].alias("m")).scalar()
    ridge_mae = m.where(ridge).agg(F.min("mae").alias("m")).scalar()
    return m.withColumn("is_best_model", F.col("model") == best).withColumn(
        "is_best_ridge", F.coalesce(F.col("model") == best_ridge, F.lit(False))).withColumn(
        "delta_vs_best_ridge", F.col("mae") - ridge_mae)


def compare_models(preds: DataFrame, reference: str, n_boot: int, ci: float, seed: int) -> DataFrame:
    """Fold-paired error of each model against the reference: wins, losses, ties, mean and median
    gap, its bootstrap interval and the share of replicates above zero."""
    fold = preds.groupBy("model", "outer_fold").agg(F.avg(F.abs(F.col("age") - F.col("age_pred"))).alias("mae"))
    ref = fold.where(F.col("model") == reference).select("outer_fold", F.col("mae").alias("ref_mae"))
    d = keep(fold.where(F.col("model") != reference).join(ref, "outer_fold").withColumn(
        "delta", F.round(F.col("mae") - F.col("ref_mae"), 9)), "deltas")
    s = d.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_folds"), F.count_if(F.col("delta") < 0).alias("n_wins"),
        F.count_if(F.col("delta") > 0).alias("n_losses"), F.count_if(F.col("delta") == 0).alias("n_ties"),
        F.avg("delta").alias("mean_delta"), F.percentile("delta", F.lit(0.5)).alias("median_delta"))
    return s.join(mean_bootstrap(d, ["model"], "outer_fold", "delta", n_boot, ci, seed), "model")


def subject_weights(rows: DataFrame, subject: str) -> DataFrame:
    """1 / rows of the subject, scaled to mean one."""
    n = rows.groupBy(subject).agg(F.count(F.lit(1)).alias("__n"))
    mean = n.agg((F.count(F.lit(1)) / F.sum("__n")).alias("m")).scalar()
    return rows.join(n, subject).withColumn("weight", 1 / F.col("__n") / mean).drop("__n")
