"""Lloyd's rounds in whole numbers, with centroids filtered in PCA-rotated coordinates.

A rotation keeps distances, and the leading principal axes hold most of them. Each vector is stored with its leading rotated
coordinates and the norm of the rest. For a vector and a centroid, the squared distance of the leading coordinates plus the
squared difference of the two norms is never above their true squared distance, so a centroid whose bound is above the
distance to the most promising one cannot win. The survivors are verified in exact whole numbers, which alone decide:
rounding in the rotation costs time at most, as the bound is lowered by far more than its error.

Each round is one pass over the stored vectors. A task sends one row of sums for each centroid; what reaches the driver is
one row for each centroid. The centroids, at most ``k`` of a fixed width, travel to the tasks with the plan.
How many coordinates lead follows from the vectors: as many as hold ``SHARE`` of their variance.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortroll.llm.common import narrow
from cohortroll.session import keep

SHARE = 0.9  # of the variance that the leading axes hold; their coordinates are stored
NARROW = 1 << 27  # components below it have squared distances within 64 bits
WIDE = 1e26  # components from it on don't fit the sums: their vectors are left out
LONGEST = 2**63 - 1
SLACK = 1e-9  # of the squared norms: what a bound is lowered by; its error is some 1e-13 of them


def usable(df: DataFrame, width: int, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v array<double>``: scaled vectors of the given width whose components are all numbers below ``WIDE``."""
    rows = narrow(df, vec_id=vec_id, v=embedding).withColumn("v", F.col("v").cast("array<double>"))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < WIDE)
    return rows.where(F.col("v").isNotNull() & (F.size("v") == width) & F.forall("v", fits)).withColumn(
        "v", F.transform("v", lambda x: x * F.lit(scale)))


def rotation(rows: DataFrame, width: int, share: float = SHARE) -> tuple[np.ndarray, int]:
    """An orthonormal matrix whose columns are the principal axes of all rows, the longest first, and how many hold ``share``."""
    if len(rows.select(F.lit(1)).head(2)) < 2:
        return np.eye(width), width
    model = PCA(k=width, inputCol="x", outputCol="y").fit(rows.select(array_to_vector("v").alias("x")))
    turned, held = np.linalg.qr(np.nan_to_num(model.pc.toArray()))[0], np.cumsum(np.nan_to_num(model.explainedVariance.toArray()))
    return turned, min(width, int(np.searchsorted(held, share)) + 1)


def whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, exactly: 64-bit if squared distances fit in them, else Python's own."""
    if not x.size or np.abs(x).max() < NARROW:
        return x.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(x)


class Centroids:
    """Centroids of whole numbers, with what filters them."""

    def __init__(self, rows: list[list[int]], axes: np.ndarray, leading: int):
        small = all(abs(x) < NARROW for row in rows for x in row)
        self.rows = np.array(rows, np.int64 if small else object).reshape(len(rows), len(axes))
        turned = self.rows.astype(float) @ axes
        self.lead, self.rest = turned[:, :leading], np.linalg.norm(turned[:, leading:], axis=1)
        self.norms = (turned**2).sum(1)

    def exact(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the centroid named for each."""
        gap = x - self.rows[which]
        return (gap * gap).sum(1)

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of each row (the smaller in a tie), its squared distance, and the survivors in all."""
        front = (lead**2).sum(1)
        bound = front[:, None] - 2 * lead @ self.lead.T + (self.lead**2).sum(1) + (rest[:, None] - self.rest)**2
        bound -= SLACK * (front + rest**2)[:, None] + SLACK * self.norms + SLACK
        hope = bound.argmin(1)
        wide = x.dtype == object or self.rows.dtype == object
        x = x.astype(object) if wide else x
        distance = self.exact(x, hope)
        at, who = np.nonzero(bound <= distance.astype(float)[:, None] * (1 + SLACK))
        found = np.full(bound.shape, 1 << 400, object) if wide else np.full(bound.shape, LONGEST)
        found[np.arange(len(x)), hope] = distance
        found[at, who] = self.exact(x[at], who)
        own = found.argmin(1)
        return own, found[np.arange(len(x)), own], len(at)


def rows_of(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists_of(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a table of numbers as one list column."""
    ends = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(values.ravel().tolist() if values.dtype == object else values.ravel(), kind))


def stored_batches(batches, axes: np.ndarray, leading: int):
    """``vec_id, v, lead, rest`` of batches ``vec_id, v``: whole components, leading rotated coordinates, norm of the others."""
    width = len(axes)
    for batch in batches:
        x = np.floor(rows_of(batch.column(1), width))
        turned = x @ axes
        lists = [lists_of(part, pa.float64()) for part in (x, turned[:, :leading])]
        rest = np.linalg.norm(turned[:, leading:], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(rest)], ["vec_id", "v", "lead", "rest"])


def assigned(batch: pa.RecordBatch, centroids: Centroids):
    x = whole(rows_of(batch.column("v"), centroids.rows.shape[1]))
    lead = rows_of(batch.column("lead"), centroids.lead.shape[1])
    return x, *centroids.nearest(x, lead, batch.column("rest").to_numpy(zero_copy_only=False))


def sum_batches(batches, centroids: Centroids):
    """One row for each centroid that a task's vectors chose: ``cluster, n, sums``."""
    k, width = centroids.rows.shape
    counts, sums = np.zeros(k, np.int64), np.zeros((k, width), object)
    for batch in batches:
        x, own, _, _ = assigned(batch, centroids)
        counts += np.bincount(own, minlength=k)
        for c in np.unique(own).tolist():
            sums[c] += x[own == c].sum(0).astype(object)
    held = np.flatnonzero(counts)
    totals = lists_of(np.frompyfunc(int, 1, 1)(sums[held]), pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held]), totals], ["cluster", "n", "sums"])


def label_batches(batches, centroids: Centroids):
    """``vec_id, cluster, distance``."""
    for batch in batches:
        _, own, distance, _ = assigned(batch, centroids)
        distance = pa.array([min(int(d), LONGEST) for d in distance] if distance.dtype == object else distance, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.int32()), distance], ["vec_id", "cluster", "distance"])


def moved(rows: list[list[int]], stored: DataFrame, axes: np.ndarray, leading: int) -> list[list[int]]:
    """The centroids after one round: componentwise floor of the mean of their vectors; those without vectors stay."""
    centroids = Centroids(rows, axes, leading)
    partial = stored.mapInArrow(lambda b: sum_batches(b, centroids), "cluster int, n bigint, sums array<decimal(38,0)>")
    total = partial.select("cluster", "n", F.posexplode("sums").alias("pos", "part")).groupBy("cluster", "pos").agg(
        F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = [list(row) for row in rows]
    for r in total.collect():  # one row for each component of a centroid
        out[r.cluster][r.pos] = int(r.total) // r.n
    return out


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: float = 256.0, seed: str = "2",
            share: float = SHARE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid``: each vector's cluster after some rounds of Lloyd's.

    Components are the whole numbers ``floor(scale * x)``. The centroids start as the ``k`` vectors whose ids have the
    smallest SHA-256 of ``seed:vec_id``, in that order; rows of one id by their components, rows without an id last. After
    ``rounds`` rounds each vector is assigned once more, to the nearest centroid, the smaller number in a tie.
    ``distance`` is squared, ``cluster_inertia`` and ``inertia`` are its sums over the cluster and over all; all three stop
    at the largest 64-bit number. ``centroid`` holds the components of the vector's centroid as decimal(38,0).

    One row per vector, repeated rows and null ids included. Left out are vectors that are null, of another length, or hold
    null, non-finite or scaled components of 1e26 or more. Fewer than k vectors make fewer centroids. An empty table
    gives no rows. Other columns aren't read.
    """
    spark = df.sparkSession
    rows = usable(df, width, scale, vec_id, embedding)
    kind = rows.schema["vec_id"].dataType.simpleString()
    axes, leading = rotation(rows, width, share)
    stored = keep(rows.mapInArrow(
        lambda b: stored_batches(b, axes, leading), f"vec_id {kind}, v array<double>, lead array<double>, rest double"), "rotated")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = stored.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    centers = [[int(x) for x in r.v] for r in first]
    for _ in range(rounds if centers else 0):
        centers = moved(centers, stored, axes, leading)
    last = Centroids(centers, axes, leading)
    labels = keep(stored.mapInArrow(lambda b: label_batches(b, last), f"vec_id {kind}, cluster int, distance bigint"), "clusters")
    inertia = [0] * len(centers)
    for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect():  # one for each centroid
        inertia[r.cluster] = int(r.s)
    return with_clusters(spark, labels, centers, inertia)


def with_clusters(spark: SparkSession, labels: DataFrame, centers: list[list[int]], inertia: list[int]) -> DataFrame:
    """The assignments with what is known of each cluster, at most k rows."""
    told = [(c, min(s, LONGEST), min(sum(inertia), LONGEST), [Decimal(x) for x in v]) for c, (s, v) in enumerate(zip(inertia, centers))]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<decimal(38,0)>")
    return labels.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(clusters: DataFrame) -> DataFrame:
    """``cluster`` 's rows with the SHA-256 of the centroid's components, joined by commas, in place of the components."""
    text = F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string")))
    return clusters.withColumn("centroid_sha256", F.sha2(text, 256)).drop("centroid")
