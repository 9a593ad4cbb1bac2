"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised on its own, so K centroids a half make K * K cells. A query visits cells in the order of
the summed distances (negative inner products, as that is the measure) of its halves to the centroid pairs, taken from a heap, until the cells hold enough candidates; those
are reranked by the exact measure. The centroids come from a bounded sample; every row is in the index.

Rows lie in blocks: the cells of one first-half centroid, dealt out by hash where they hold many rows. A query goes once to
each block that it visits, with the list of its cells there, so a task works on a bounded block of rows and queries.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortroll.llm.common import bounded_sample, narrow
from cohortroll.session import keep

CENTROIDS = 32  # of each half
SAMPLE = 20_000  # rows that the centroids are fitted on at most: those with the smallest hash of their id
SHARE = 0.6  # of all rows that a query's cells must hold
LEAST = 2_000  # rows that they must hold at least
BLOCK = 8_192  # rows, and queries, that meet in one group
STRIP = 128  # queries whose scores are held at once
SLACK = 1e-9  # scores of whole blocks may differ from a row's own by rounding


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of the rows by Lloyd's rounds, from evenly spread first ones; fewer if there are fewer distinct rows."""
    x = np.unique(x, axis=0)
    centers = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(centers))
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centroids."""
    return (x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return distances(x, centers).argmin(1)


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells (i, j) by rising ``first[i] + second[j]`` until they hold enough rows: the multi-sequence walk with a heap."""
    by_i, by_j = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, cells, held = [(first[by_i[0]] + second[by_j[0]], 0, 0)], [], 0
    while heap and held < enough:
        _, a, b = heappop(heap)
        i, j = int(by_i[a]), int(by_j[b])
        if counts[i, j]:
            cells.append((i, j))
            held += int(counts[i, j])
        if b + 1 < len(by_j):
            heappush(heap, (first[by_i[a]] + second[by_j[b + 1]], a, b + 1))
        if b == 0 and a + 1 < len(by_i):
            heappush(heap, (first[by_i[a + 1]] + second[by_j[0]], a + 1, 0))
    return cells


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v array<double>``: rows with an id and a vector of finite numbers that aren't all zero."""
    rows = narrow(df, vec_id=vec_id, v=embedding).withColumn("v", F.col("v").cast("array<double>"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def search(df: DataFrame, every: int = 20, k: int = 20, centroids: int = CENTROIDS, share: float = SHARE, least: int = LEAST,
           vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k found rows of largest inner product for each row whose id ``every`` divides.

    Scores are inner products of the original vectors in double precision, ranks run from 1, ties go to the smaller id.
    Candidates are all rows of another id; with fewer than k of them, all. Rows without an id, and vectors that are null,
    empty, zero or hold null or non-finite components, take no part; nor do vectors of another length than the most
    frequent (the longer in a tie). Ids are expected to be distinct: equal ids are no candidates of one another, and the
    smallest vector of an id asks for it. Other columns aren't read. An empty table gives no rows.
    """
    rows = usable(df, vec_id, embedding)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = "query_id bigint, vec_id bigint, score double"
    if not sizes:
        return df.sparkSession.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    width, total = sizes[0].d, sizes[0].n
    half = (width + 1) // 2
    rows = rows.where(F.size("v") == width).withColumn("vec_id", F.col("vec_id").cast("bigint"))
    sample = np.stack(bounded_sample(rows, "vec_id", SAMPLE).toPandas().v.to_list())
    books = kmeans(sample[:, :half], centroids), kmeans(sample[:, half:], centroids)

    @F.pandas_udf("i int, j int")
    def cell(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_list()) if len(v) else np.zeros((0, width))
        return pd.DataFrame({"i": nearest(x[:, :half], books[0]), "j": nearest(x[:, half:], books[1])})

    index = keep(rows.withColumn("c", cell("v")).select("vec_id", "v", "c.i", "c.j"), "multi-index")
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in index.groupBy("i", "j").agg(F.count("*").alias("n")).collect():  # at most centroids ** 2 rows
        counts[r.i, r.j] = r.n
    salts = -(-counts.sum(1) // BLOCK)
    enough = int(max(least, np.ceil(share * total)))
    asking = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = max(1, -(-asking.count() // BLOCK))  # of the queries

    @F.pandas_udf("array<struct<i: int, salt: int, cells: array<int>>>")
    def visits(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_list()) if len(v) else np.zeros((0, width))
        out = []
        for a, b in zip(-x[:, :half] @ books[0].T, -x[:, half:] @ books[1].T):  # nearness is the inner product
            by_i: dict[int, list[int]] = {}
            for i, j in visit(a, b, counts, enough):
                by_i.setdefault(i, []).append(j)
            out.append([{"i": i, "salt": s, "cells": js} for i, js in by_i.items() for s in range(salts[i])])
        return pd.Series(out)

    salt_of = F.element_at(F.array(*[F.lit(int(max(s, 1))) for s in salts]), F.col("i") + 1)
    by_id = F.xxhash64("vec_id")
    blocks = index.select("vec_id", "v", "i", "j", F.pmod(by_id, salt_of.cast("bigint")).cast("int").alias("salt"),
                          F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    queries = asking.select("vec_id", "v", F.pmod(by_id, F.lit(parts)).cast("int").alias("part"), F.explode(visits("v")).alias("b"))
    queries = queries.select("vec_id", "v", F.col("b.i").alias("i"), F.col("b.salt").alias("salt"), "part", F.col("b.cells").alias("cells"))

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(held):
            x, ids, js = np.stack(held.v.to_list()), held.vec_id.to_numpy(), held.j.to_numpy()
            q, asks = np.stack(asked.v.to_list()), asked.vec_id.to_numpy()
            in_cell = {j: np.flatnonzero(js == j) for j in np.unique(js).tolist()}
            visited = np.zeros((len(q), counts.shape[1]), bool)
            for n, cells in enumerate(asked.cells):
                visited[n, cells] = True
            for at in range(0, len(q), STRIP):
                strip = slice(at, at + STRIP)
                scores = np.full((len(q[strip]), len(x)), -np.inf)
                for j, members in in_cell.items():
                    ask = np.flatnonzero(visited[strip, j])
                    if len(ask):
                        scores[np.ix_(ask, members)] = q[strip][ask] @ x[members].T
                scores[asks[strip][:, None] == ids] = -np.inf
                for n, row in enumerate(scores):
                    bar = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    near = np.flatnonzero((row >= bar - SLACK) & (row > -np.inf))
                    exact = (x[near] * q[at + n]).sum(1)
                    first = np.lexsort((ids[near], -exact))[:k]
                    found.append((np.full(len(first), asks[at + n]), ids[near][first], exact[first]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))

    near = queries.groupBy("i", "salt", "part").cogroup(blocks.groupBy("i", "salt", "part")).applyInPandas(best, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
