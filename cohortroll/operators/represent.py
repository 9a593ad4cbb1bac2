"""Representation, neighbours, clustering and labels of cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortroll.functions.scalar import hash_int, log_normalise
from cohortroll.operators.ordering import top_per_group
from cohortroll.operators.qc import variable_genes
from cohortroll.operators.rollup import dominant
from cohortroll.session import dealt, keep

BLOCK = 512
CHUNK = 2048  # rows of a tile that a block is multiplied with at once
TILES, TILE_ROWS, TILE_BYTES = 12, 1024, 1 << 25  # tiles of a side; rows that are no use to cut; bytes of vectors in a tile, at most


def pca_representation(counts: DataFrame, cells: DataFrame, n_genes: int, k: int, target: float = 1e4) -> DataFrame:
    """Principal components of log-normalised expression over the most variable genes.

    Counts, cells and each cell's few values are written once for all the passes over them; rows become dense where they
    are read.
    """
    counts, cells = keep(counts.select("cell_id", "gene_id", "count"), "counts"), keep(cells.select("cell_id"), "cells")
    chosen = keep(variable_genes(counts, cells, n_genes).select("gene_id"), "genes")
    index = chosen.orderBy("gene_id").limit(n_genes).agg(F.array_sort(F.collect_list("gene_id")).alias("a")).scalar()
    at = (F.array_position(index, F.col("gene_id")) - 1).cast("int")
    placed = dealt(counts.withColumn("i", at), counts.count(), "cell_id").groupBy("cell_id").agg(
        F.sum("count").alias("total"), F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "count"))).alias("seen"))
    packed = placed.where(F.size("seen") > 0).withColumn("e", F.explode("seen")).select(
        "cell_id", F.col("e.i").alias("i"), log_normalise("e.count", "total", target).alias("x")).groupBy("cell_id").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("values"))
    rows = keep(cells.join(packed, "cell_id", "left"), "rows")
    dense = F.when(F.col("values").isNull(), F.array_repeat(F.lit(0.0), n_genes)).otherwise(F.transform(
        F.sequence(F.lit(0), F.lit(n_genes - 1)), lambda i: F.coalesce(F.element_at("values", i), F.lit(0.0))))
    rows = rows.select("cell_id", array_to_vector(dense).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="pc").fit(rows)
    return model.transform(rows).select("cell_id", vector_to_array("pc").alias("vec"))


def _assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot and the distance to it."""
    norms = (pivots ** 2).sum(1)

    def near(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["vec"].to_numpy()).astype(float)
            d2 = np.maximum((v ** 2).sum(1)[:, None] + norms - 2 * v @ pivots.T, 0)
            at = d2.argmin(1)
            pdf["cell"] = at.astype("int32")
            pdf["d"] = np.sqrt(d2[np.arange(len(at)), at])
            yield pdf

    return vectors.mapInPandas(near, "rep long, vec array<float>, cell int, d double")


def tile_count(rows: int, width: int) -> int:
    """Tiles that each side of the neighbour search is cut into: a fixed number unless the table is small or a tile too large."""
    return max(min(TILES, -(-rows // TILE_ROWS)), -(-rows * width * 4 // TILE_BYTES), 1)


def _nearest(a: pa.Table, b: pa.Table, gap: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of tile b to each row of tile a by distance, ties by id: ids, ids found, distances.

    Products only pick candidates, with room for their rounding; what counts are the differences' norms.
    """
    def arrays(t: pa.Table):
        t = t.sort_by([("cell", "ascending"), ("rep", "ascending")])
        ids, cell, d = (t[c].to_numpy() for c in ("rep", "cell", "d"))
        return ids, cell, d, t["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(float)

    (a_ids, a_cell, a_d, a_vec), (b_ids, b_cell, b_d, b_vec) = arrays(a), arrays(b)
    b_norm = (b_vec ** 2).sum(1)
    size = max((a_vec ** 2).sum(1).max(), b_norm.max())
    slack, margin = 1e-12 * size, 1e-6 * np.sqrt(size) + 1e-8
    turned = np.concatenate([-2 * b_vec, b_norm[:, None]], axis=1)
    starts = np.flatnonzero(np.r_[True, a_cell[1:] != a_cell[:-1]])
    out = []
    for at, end in zip(starts, np.append(starts[1:], len(a_ids))):
        i, apart = int(a_cell[at]), gap[a_cell[at], b_cell]
        for s in range(at, end, BLOCK):
            own = a_vec[s:min(s + BLOCK, end)]
            norm, ones = (own ** 2).sum(1), np.concatenate([own, np.ones((len(own), 1))], axis=1)
            far = a_d[s:s + len(own)].max()
            row, col, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            worst = np.full(len(own), np.inf)
            for t in range(0, len(b_ids), CHUNK):
                # Both rings around the pivots bound the distance from below.
                low = np.maximum(apart[t:t + CHUNK] - b_d[t:t + CHUNK], b_d[t:t + CHUNK] - apart[t:t + CHUNK]) - far
                near = np.flatnonzero(low <= min(bound[i], worst.max()) + margin)
                if not len(near):
                    continue
                part = turned[t:t + CHUNK] if len(near) == len(low) else turned[t + near]
                d2 = ones @ part.T
                most = worst
                if len(near) > k and np.isinf(worst).any():
                    kth = np.sqrt(np.maximum(np.partition(d2, k - 1, axis=1)[:, k - 1] + norm, 0) + slack)
                    most = np.minimum(worst, kth)
                r, c = np.nonzero(d2 <= ((most + 1e-8) ** 2 - norm + slack)[:, None])
                c = t + near[c]
                new = np.empty(len(r))
                for v in range(0, len(r), CHUNK):
                    new[v:v + CHUNK] = np.round(np.sqrt(((own[r[v:v + CHUNK]] - b_vec[c[v:v + CHUNK]]) ** 2).sum(1)), 9)
                row, col, dist = np.concatenate([row, r]), np.concatenate([col, c]), np.concatenate([dist, new])
                order = np.lexsort((b_ids[col], dist, row))
                row, col, dist = row[order], col[order], dist[order]
                first = np.searchsorted(row, np.arange(len(own) + 1))
                kept = np.arange(len(row)) - first[row] < k
                row, col, dist = row[kept], col[kept], dist[kept]
                n = np.bincount(row, minlength=len(own))
                full = n == k
                worst[full] = dist[np.cumsum(n)[full] - 1]
            out.append((a_ids[s + row], b_ids[col], dist))
    return tuple(np.concatenate(c) for c in zip(*out))


def exact_neighbours(vectors: DataFrame, k: int, max_pivots: int = 512) -> DataFrame:
    """The k nearest other rows of each row by euclidean distance, ties by id, exact.

    Copies of one vector are folded to a representative with its first k + 1 ids, which is all any
    list can use. Representatives are dealt into tiles, ``TILES`` unless they outgrow ``TILE_BYTES``, and every
    pair of tiles meets in a task, so a vector is sent a fixed number of times, not once for each block it is held
    against. Inside, rows are ordered by the pivot they lie around; the triangle inequality drops those that cannot be
    a neighbour, the rest meet in bounded products, and a task gives back only the best rows per query.
    Input: cell_id (long), vec. Output: src, dst, dist, rank.
    """
    ids = vectors.select(F.col("cell_id").cast("long").alias("cell_id"), "vec")
    first = top_per_group(ids, ["vec"], [F.col("cell_id")], k + 1, "r")
    reps = keep(first.groupBy("vec").agg(F.min("cell_id").alias("rep"),
                                         F.array_sort(F.collect_list("cell_id")).alias("members")), "reps")
    size = reps.count()
    n_pivots = int(min(max_pivots, max(1, size // (BLOCK // 2))))
    chosen = reps.orderBy(hash_int("rep"), "rep").limit(n_pivots).select("vec").collect()  # at most max_pivots rows
    pivots = np.array([r["vec"] for r in chosen], float)
    placed = keep(_assign(reps.select("rep", "vec"), pivots), "placed")
    # Bounds per cell from at most k + 1 short distances and the radius of each cell.
    radius = {r["cell"]: r["u"] for r in placed.groupBy("cell").agg(F.max("d").alias("u")).collect()}
    close = top_per_group(placed.select("cell", "d", "rep"), ["cell"], [F.col("d"), F.col("rep")], k + 1, "r").collect()
    gap = np.sqrt(np.maximum((pivots ** 2).sum(1)[:, None] + (pivots ** 2).sum(1) - 2 * pivots @ pivots.T, 0))
    at, d = np.array([r["cell"] for r in close]), np.array([r["d"] for r in close])
    need = min(k + 1, size)
    bound, margin = np.full(len(pivots), np.inf), 1e-6 * float(np.sqrt((pivots ** 2).sum(1).max())) + 1e-9
    for i, u in radius.items():
        # The pivots' distances are good to a rounding of their squares.
        bound[i] = float(np.partition(u + gap[i, at] + d, need - 1)[need - 1]) * (1 + 1e-9) + margin
    tiles = tile_count(size, pivots.shape[1])
    pair = ["tile", "other"]
    own, every = F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))

    def side(mine: str, others: str):
        rows = placed.withColumn(mine, own).withColumn(others, every)
        return rows.select(*pair, *placed.columns).repartition(tiles * tiles, *pair).groupBy(*pair)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"rep": pa.array([], pa.int64()), "near_rep": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        return pa.table(dict(zip(("rep", "near_rep", "dist"), _nearest(a, b, gap, bound, k + 1))))

    found = side("tile", "other").cogroup(side("other", "tile")).applyInArrow(best, "rep long, near_rep long, dist double")
    found = top_per_group(found, ["rep"], [F.col("dist"), F.col("near_rep")], k + 1, "r")
    full = found.join(reps.select(F.col("rep").alias("near_rep"), "members"), "near_rep").select(
        "rep", "dist", F.explode("members").alias("dst"))
    full = top_per_group(full, ["rep"], [F.col("dist"), F.col("dst")], k + 1, "r")
    lists = full.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("l"))
    named = ids.join(reps.select("vec", "rep"), "vec").select("cell_id", "rep")
    out = named.join(lists, "rep").select("cell_id", F.slice(F.filter(
        "l", lambda s: s["dst"] != F.col("cell_id")), 1, k).alias("l"))
    return out.select(F.col("cell_id").alias("src"), F.posexplode("l").alias("i", "s")).select(
        "src", F.col("s.dst").alias("dst"), F.col("s.dist").alias("dist"), (F.col("i") + 1).alias("rank"))


def cluster_vectors(vectors: DataFrame, k: int, seed: int = 1, max_iter: int = 20) -> DataFrame:
    rows = vectors.select("cell_id", array_to_vector("vec").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(rows)
    return model.transform(rows).select("cell_id", F.col("prediction").alias("cluster"))


def partition_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information from the contingency table."""
    cont = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = cont.groupBy(a).agg(F.sum("n").alias("n")), cont.groupBy(b).agg(F.sum("n").alias("n"))

    def sums(t, tag):
        n = F.col("n")
        return t.agg(F.struct(F.sum(n * (n - 1) / 2).alias("pairs"), F.sum(n * F.log(n)).alias("nlogn"),
                              F.sum(n).alias("n")).alias(tag))

    one = sums(cont, "c").withColumn("a", sums(rows, "a").scalar()).withColumn("b", sums(cols, "b").scalar())
    n = F.col("c.n")
    expected = F.col("a.pairs") * F.col("b.pairs") / (n * (n - 1) / 2)
    ari = F.try_divide(F.col("c.pairs") - expected, (F.col("a.pairs") + F.col("b.pairs")) / 2 - expected)
    ha, hb = F.log(n) - F.col("a.nlogn") / n, F.log(n) - F.col("b.nlogn") / n
    mi = (F.col("c.nlogn") - F.col("a.nlogn") - F.col("b.nlogn")) / n + F.log(n)
    return one.select(F.coalesce(ari, F.lit(1.0)).alias("ari"),
                      F.coalesce(F.try_divide(mi, (ha + hb) / 2), F.lit(1.0)).alias("nmi"))


def classify_cells(cells: DataFrame, counts: DataFrame, weights: DataFrame, intercepts: DataFrame,
                   target: float = 1e4) -> DataFrame:
    """Label with the highest one-vs-rest probability on log-normalised expression.

    ``weights`` (gene_id, label, coef) and ``intercepts`` (label, intercept) are the model. Cells
    without entries of any model gene are scored by the intercepts alone.
    """
    totals = counts.groupBy("cell_id").agg(F.sum("count").alias("total"))
    x = counts.join(weights.select("gene_id").distinct(), "gene_id", "left_semi").join(totals, "cell_id").select(
        "cell_id", "gene_id", log_normalise("count", "total", target).alias("x"))
    sums = x.join(weights, "gene_id").groupBy("cell_id", "label").agg(F.sum(F.col("coef") * F.col("x")).alias("s"))
    labels = intercepts.agg(F.array_sort(F.collect_list(F.struct("label", "intercept"))).alias("l"))
    grid = cells.select("cell_id", F.inline(labels.scalar()))
    z = grid.join(sums, ["cell_id", "label"], "left").withColumn(
        "p", 1 / (1 + F.exp(-(F.col("intercept") + F.coalesce("s", F.lit(0.0))))))
    best = F.min(F.struct((-F.round("p", 12)).alias("k"), F.col("label").alias("label")))
    return z.groupBy("cell_id").agg(best.alias("b")).select(
        "cell_id", F.col("b.label").alias("label"), (-F.col("b.k")).alias("confidence"))


def train_label_model(vectors: DataFrame, label: str, max_iter: int = 20, reg: float = 0.01) -> DataFrame:
    """Coefficients of a multinomial linear classifier as a (label_index, dim, coef) table."""
    rows = vectors.select(F.col(label).cast("double").alias("label"), array_to_vector("vec").alias("features"))
    model = LogisticRegression(maxIter=max_iter, regParam=reg).fit(rows)
    m = model.coefficientMatrix.toArray()
    data = [(int(i), int(j), float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return vectors.sparkSession.createDataFrame(data, "label_index int, dim int, coef double")


def majority_vote(cells: DataFrame, cluster: str, label: str, enabled: bool = True) -> DataFrame:
    """Most frequent label of a cell's cluster (smallest on ties)."""
    if not enabled:
        return cells.withColumn("majority_label", F.col(label))
    top = dominant(cells, [cluster], label, "majority_label").drop("majority_label_share")
    return cells.join(top, cluster, "left")


def cluster_sizes(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))
