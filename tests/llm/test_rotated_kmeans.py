"""Rotated k-means against plain Lloyd's rounds in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from cohortroll.llm import queries, rotated_kmeans

LONGEST = 2**63 - 1


def plain(rows, k=40, rounds=5, width=64):
    """``cluster``'s rows of ``(vec_id, vector)`` with digests, each distance by hand."""
    kept = []
    for key, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(256 * x) < 1e26 for x in v):
            kept.append((key, [math.floor(256 * x) for x in v]))
    by = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(kept, key=by)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            centers[c] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    sums = [sum(d for d, n in last if n == c) for c in range(len(centers))]
    stop = lambda x: min(x, LONGEST)
    return sorted(((-1 if key is None else key, n, stop(d), stop(sums[n]), stop(sum(sums)), hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest())
                   for (key, _), (d, n) in zip(kept, last)))


def run(spark, tmp_path, rows):
    folder = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
    frame = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id bigint, embedding array<float>, lead string, cluster int")
    frame.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in queries.op11_rotated_kmeans(spark, folder).collect())


def floats(values):
    return np.asarray(values, np.float32).astype(float).tolist()


def test_query_is_plain_lloyd(spark, tmp_path):
    rng = np.random.default_rng(4)
    spread = rng.normal(size=(64, 64)) * (0.9 ** np.arange(64))[:, None]
    rows = [(k, floats(v)) for k, v in enumerate(rng.normal(size=(300, 64)) @ spread)]
    rows += [(k, rows[0][1]) for k in range(300, 360)]  # copies
    rows += [(7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [math.nan] + [1.0] * 63),
             (905, [math.inf] + [1.0] * 63), (906, [0.0] * 64), (907, [-0.001] * 64)]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_ties_few_vectors_and_none(spark, tmp_path):
    rng = random.Random(5)
    grid = [(k, [float(rng.randint(0, 1))] * 2 + [0.0] * 62) for k in range(200)]  # four distinct vectors: most centroids are equal
    assert run(spark, tmp_path, grid) == plain(grid)
    few = [(k, [float(k)] * 64) for k in range(3)]
    assert run(spark, tmp_path, few) == plain(few)
    assert run(spark, tmp_path, few[:1]) == plain(few[:1])
    assert run(spark, tmp_path, [(1, None)]) == []


def test_components_beyond_64_bits(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, floats([rng.choice([1e6, -3e9, 2e20, 7.5]) * rng.random() for _ in range(64)])) for k in range(60)]
    rows += [(k, floats([rng.random() for _ in range(64)])) for k in range(60, 80)] + [(99, [3e38] + [0.0] * 63)]
    got = run(spark, tmp_path, rows)
    assert got == plain(rows) and got[0][4] == LONGEST


@pytest.mark.parametrize("leading", [1, 8, 63, 64])
def test_filter_keeps_every_nearest_centroid(leading):
    rng = np.random.default_rng(leading)
    x = np.floor(rng.normal(size=(500, 64)) * 200 * (0.8 ** np.arange(64)) + 1000)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    centers = rotated_kmeans.Centroids(x[:50].astype(int).tolist(), axes, leading)
    turned = x @ axes
    own, distance, survivors = centers.nearest(x.astype(np.int64), turned[:, :leading], np.linalg.norm(turned[:, leading:], axis=1))
    every = ((x[:, None] - x[None, :50]) ** 2).sum(2)
    assert (own == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert survivors < 500 * 50 * (1 if leading < 8 else 0.3)
