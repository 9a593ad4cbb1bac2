"""Histogram-boosted trees for every fold and candidate in one plan, and nested selection over all candidates.

Every (outer fold, inner fold, candidate) is a key: one grouped plan fits them all, one pass over the rows predicts with all of
them. A fit sees at most ``TRAIN_ROWS`` of its training rows, those with the smallest hashes, all of a smaller table; errors,
choices and predictions cover all rows. Models are arrays of complete trees, bounded by folds, candidates, trees and depth, and
travel with the plan of the prediction pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortroll.operators.predict import ALPHAS, ridge_fits, ridge_predictions, roll_to_sample, training_baseline, with_folds
from cohortroll.session import keep

TRAIN_ROWS = 100_000  # rows that one fit is made on at most
BINS = 64


@dataclass(frozen=True)
class Boosting:
    """Settings of one tree candidate."""

    name: str
    n_trees: int = 300
    depth: int = 4
    rate: float = 0.05
    penalty: float = 0.0
    rows: float = 1.0  # share of the rows, and of the columns, that a tree sees
    columns: float = 1.0
    min_rows: int = 20
    min_weight: float = 0.0


# The default candidates of the two tree families.
FAMILIES = (
    Boosting("hist_gbr_1"),
    Boosting("xgboost_1", n_trees=300, depth=3, penalty=1.0, rows=0.8, columns=0.8, min_rows=1, min_weight=1.0),
    Boosting("xgboost_2", n_trees=500, depth=4, penalty=1.0, rows=0.8, columns=0.8, min_rows=1, min_weight=1.0),
)


def fit_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray, settings: Boosting, seed: Sequence[int]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """``base, feature, threshold, value`` of squared-error boosting; trees are complete, level by level, in rows of the arrays.

    A row goes right at a node if its feature is above the threshold; a node that isn't split has an infinite one.
    """
    rng = np.random.Generator(np.random.Philox(key=np.array(seed, np.uint64)))
    n, width = x.shape
    depth, inner = settings.depth, 2**settings.depth - 1
    base = float((w * y).sum() / w.sum())
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(width)]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1)  # bin <= k if x <= edge k
    feature, threshold, value = np.zeros((settings.n_trees, inner), np.int64), np.full((settings.n_trees, inner), np.inf), np.zeros((settings.n_trees, inner + 1))
    total = np.full(n, base)
    for t in range(settings.n_trees):
        seen = rng.random(n) < settings.rows if settings.rows < 1 else np.ones(n, bool)
        cols = np.sort(rng.choice(width, max(1, round(settings.columns * width)), replace=False)) if settings.columns < 1 else np.arange(width)
        g, cell = (y - total) * w, bins[:, cols] + np.arange(len(cols)) * BINS
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            at = ((node - first)[seen, None] * (len(cols) * BINS) + cell[seen]).ravel()
            shape = (2**level, len(cols), BINS)
            gs, hs, cs = (np.bincount(at, np.repeat(v[seen], len(cols)), int(np.prod(shape))).reshape(shape).cumsum(2) for v in (g, w, np.ones(n)))
            ga, ha, ca = gs[:, :, -1:], hs[:, :, -1:], cs[:, :, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gs**2 / (hs + settings.penalty) + (ga - gs)**2 / (ha - hs + settings.penalty) - ga**2 / (ha + settings.penalty)
            few = (np.minimum(cs, ca - cs) < settings.min_rows) | (np.minimum(hs, ha - hs) < settings.min_weight)
            gain = np.where(few | ~np.isfinite(gain), 0.0, gain).reshape(shape[0], -1)
            best = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(len(best)), best] > 1e-9).tolist():
                f, cut = divmod(int(best[k]), BINS)
                if cut < len(edges[cols[f]]):
                    feature[t, first + k], threshold[t, first + k] = cols[f], edges[cols[f]][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf[seen], g[seen], inner + 1), np.bincount(leaf[seen], w[seen], inner + 1)
        value[t] = np.where(hs > 0, settings.rate * gs / np.where(hs > 0, hs + settings.penalty, 1.0), 0.0)
        total += value[t, leaf]
    return base, feature, threshold, value


def walk(x: np.ndarray, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Predictions of all rows."""
    total, rows = np.full(len(x), base), np.arange(len(x))
    for f, cut, v in zip(feature, threshold, value):
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(v)))):
            node = 2 * node + 1 + (x[rows, f[node]] > cut[node])
        total += v[node - len(f)]
    return total


def design(pdf: pd.DataFrame, types: Sequence[str], width: int) -> np.ndarray:
    """Latent coordinates, then one column for each type."""
    place = {t: k for k, t in enumerate(types)}
    hot = np.zeros((len(pdf), len(types)), np.float32)
    at = [place.get(str(t), -1) for t in pdf["cell_type"]]
    hot[np.arange(len(pdf)), at] = np.array(at) >= 0
    return np.hstack([np.stack(pdf["vec"].to_list()).astype(np.float32).reshape(len(pdf), width), hot])


def held_out_fits(outer: int, inner: int) -> list[tuple[int, int]]:
    """All fits: ``(o, -1)`` on everything outside fold o, ``(o, i)`` also outside inner fold i."""
    return [(o, i) for o in range(outer) for i in (-1, *range(inner))]


def tree_fits(rows: DataFrame, candidates: Sequence[Boosting], types: Sequence[str], width: int, outer: int, inner: int, seed: int,
              most: int = TRAIN_ROWS) -> dict[tuple[int, int, str], tuple]:
    """Every fit's ``base, feature, threshold, value, lo, hi``, by (outer fold, inner fold or -1, candidate)."""
    by_name = {c.name: c for c in candidates}
    fits = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(i).alias("i")) for o, i in held_out_fits(outer, inner)])
    train = rows.withColumn("__h", F.xxhash64("subject_id", "sample_unit_id", "cell_type")).select(
        "*", F.inline(F.filter(fits, lambda f: (f["o"] != F.col("outer_fold")) & (f["i"] != F.col("inner_fold")))))
    sizes = train.groupBy("o", "i").agg(F.count(F.lit(1)).alias("n"))
    # Only hashes up to a bound, with room to spare, are sent on where a fit has more rows than it may see.
    share = F.least(F.lit(1.0), (1.1 * most + 1000) / F.col("n"))
    bound = train.join(F.broadcast(sizes), ["o", "i"]).where((F.col("__h") / 2.0**64 + 0.5) <= share)  # one row for each fit is broadcast
    names = F.explode(F.array(*[F.lit(c.name) for c in candidates]))
    cols = bound.select("o", "i", names.alias("name"), "__h", "subject_rows", F.col("cell_type").cast("string").alias("cell_type"), "age", "vec", "sample_unit_id")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__h", "sample_unit_id", "cell_type"]).head(most)
        o, i, name = int(pdf["o"].iloc[0]), int(pdf["i"].iloc[0]), pdf["name"].iloc[0]
        w = 1 / pdf["subject_rows"].to_numpy(float)
        y = pdf["age"].to_numpy(float)
        base, feature, threshold, value = fit_trees(design(pdf, types, width), y, w / w.mean(), by_name[name], (seed, (o + 1) * 10_000 + i + 1))
        return pd.DataFrame({"o": [o], "i": [i], "name": [name], "base": [base], "feature": [feature.ravel()], "threshold": [threshold.ravel()],
                             "value": [value.ravel()], "lo": [y.min()], "hi": [y.max()]})

    schema = "o int, i int, name string, base double, feature array<bigint>, threshold array<double>, value array<double>, lo double, hi double"
    models = keep(cols.groupBy("o", "i", "name").applyInPandas(fit, schema), "trees")
    out = {}
    for r in models.toLocalIterator():  # folds x candidates rows of bounded arrays
        inner_nodes = 2 ** by_name[r.name].depth - 1
        out[r.o, r.i, r.name] = (r.base, np.array(r.feature).reshape(-1, inner_nodes), np.array(r.threshold).reshape(-1, inner_nodes),
                                 np.array(r.value).reshape(-1, inner_nodes + 1), r.lo, r.hi)
    return out


def tree_predictions(rows: DataFrame, models: dict, types: Sequence[str], width: int, clip: bool = True) -> DataFrame:
    """``rows`` without vectors, with ``fit_outer``, ``fit_inner``, ``model`` and ``age_pred`` for every fit that a row is held out of."""
    told = [c for c in rows.columns if c not in ("vec", "inner_fold")]

    def predict(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            x, outer, inner = design(pdf, types, width), pdf["outer_fold"].to_numpy(), pdf["inner_fold"].to_numpy()
            for (o, i, name), (base, feature, threshold, value, lo, hi) in models.items():
                at = np.flatnonzero((outer == o) if i < 0 else ((outer != o) & (inner == i)))
                if len(at):
                    y = walk(x[at], base, feature, threshold, value)
                    yield pdf.iloc[at][told].assign(fit_outer=np.int32(o), fit_inner=np.int32(i), model=name, age_pred=np.clip(y, lo, hi) if clip else y)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in told), "fit_outer int, fit_inner int, model string, age_pred double"])
    return rows.mapInPandas(predict, schema)


def choose_candidates(inner: DataFrame, names: Sequence[str], keys: Sequence[str] = ("subject_id", "sample_unit_id")) -> DataFrame:
    """``fit_outer, model, mae``: per outer fold the candidate of least mean absolute error on its inner folds.

    Predictions are rolled up to samples first, weighted by cells. Ties go to the candidate named first; candidates without a
    finite error are never chosen.
    """
    rolled = roll_to_sample(inner.withColumn("age_base", F.col("age")), ["fit_outer", "model", *keys])
    error = rolled.groupBy("fit_outer", "model").agg(F.avg(F.abs(F.col("age") - F.col("age_pred"))).alias("mae")).where(
        F.col("mae").isNotNull() & ~F.isnan("mae"))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("model"))
    best = F.min_by(F.struct("model", "mae"), F.struct(F.round("mae", 12), place))
    return error.groupBy("fit_outer").agg(best.alias("b")).select("fit_outer", "b.model", "b.mae")


def nested_models(rows: DataFrame, subject: str, outer: int = 5, inner: int = 3, alphas: Sequence[float] = ALPHAS,
                  trees: Sequence[Boosting] = FAMILIES, seed: int = 0, max_types: int = 1000, most: int = TRAIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions of every ridge and tree candidate, and of the nested model that picks its candidate inside each outer fold.

    Input: subject, sample_unit_id, cell_type, age, n_cells, vec, one row per profile. Returns the predictions with ``model`` and the
    choices. No subject of a test fold, outer or inner, is in the training rows of its fit.
    """
    rows = keep(with_folds(rows, subject, outer, inner), "folds")
    first = rows.agg(F.max(F.size("vec")).alias("w"), F.count_distinct("cell_type").alias("n")).first()
    if first["n"] > max_types:
        raise ValueError(f"{first['n']} types are too many for one-hot columns")
    types = list(rows.agg(F.array_sort(F.collect_set(F.col("cell_type").cast("string")))).first()[0])
    linear = ridge_predictions(rows, keep(ridge_fits(rows, types, first["w"], outer, inner, alphas), "ridge"), types)
    linear = linear.withColumn("model", F.format_string("ridge_alpha_%s", F.col("alpha").cast("string")))
    told = [subject, "sample_unit_id", "cell_type", "age", "n_cells", "outer_fold", "fit_outer", "fit_inner", "model", "age_pred"]
    both = linear.select(*told)
    if trees:
        models = tree_fits(rows, trees, types, first["w"], outer, inner, seed, most)
        both = both.unionByName(tree_predictions(rows, models, types, first["w"]).select(*told))
    both = keep(both, "candidates")
    names = [*(f"ridge_alpha_{a}" for a in map(float, alphas)), *(t.name for t in trees)]
    choices = keep(choose_candidates(both.where("fit_inner >= 0"), names, (subject, "sample_unit_id")), "choices")
    held = both.where("fit_inner = -1")
    nested = held.join(choices.select("fit_outer", "model"), ["fit_outer", "model"]).withColumn("model", F.lit("nested_best"))
    out = held.unionByName(nested).drop("fit_outer", "fit_inner")
    return out.join(training_baseline(rows, subject), "outer_fold"), choices
