"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are a ring of eight segments. Two fingerprints that differ in at most two bits have a segment from
which every chain of l following segments differs in at most l * 2 / 8 bits: three equal segments, then at most one
difference over the next four. The join key is the three segments together with one half of those four (at least one
half is equal), 40 equal bits in all, so a key holds few fingerprints unless they are alike, and never over 2 ** 24.
Fingerprints that share a key must keep to the whole chain before their full distance counts.

Copies collapse to one fingerprint before that. A key's fingerprints send on a spanning forest of their links, not all
pairs, and connected components follow from those edges.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortroll.session import keep

DISTANCE = 2
SHINGLE = 3
SEED = 42
PART = 100_000  # shingles that are held at once
PAIRED = 256  # fingerprints under one key that are compared pair by pair; more are found by their possible neighbours

MASKS = (0xFFFFFFFFFF000000, 0xFFFFFF0000FFFF00)  # three segments and the first or second half of the next four
CHAIN_SHIFT = 8  # what is left above it are the seven segments that may differ in one bit


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text: a bit is 1 if it is set in over half the hashes of its shingles.

    Words are what white space of ASCII separates, capitals A-Z made small. Fewer words than a shingle has are one
    shingle; a text without words, or null, has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, PART):
        part = words[k:min(k + PART, n) + shingle - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprint(text: Column) -> Column:
    """``simhash`` as a column of type long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t) for t in texts], dtype="int64")

    return run(text)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components under the links a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if (new == root).all():
            return root
        root = new


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    x = x.astype(np.uint64)
    return x if not bits else x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _links(prints: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places) of sorted distinct fingerprints under one key that keep to the chain and the distance."""
    turn, half = divmod(tag, 2)
    if len(prints) <= PAIRED:
        a, b = np.triu_indices(len(prints), 1)
        apart = _turned(prints[a] ^ prints[b], 8 * turn)
        chained = np.bitwise_count(apart >> np.uint64(CHAIN_SHIFT)) <= DISTANCE - 1
        a, b, apart = a[chained], b[chained], apart[chained]
        near = np.bitwise_count(apart) <= DISTANCE
        return a[near], b[near]
    # Many under one key: look up each one's possible neighbours, which keep to the chain by construction.
    free = [1 << k for k in range(64) if not MASKS[half] >> k & 1]
    back = lambda mask: (mask >> 8 * turn | mask << (64 - 8 * turn)) & (1 << 64) - 1
    order = np.argsort(prints.view(np.uint64), kind="stable")
    by_value = prints.view(np.uint64)[order]
    found = []
    for mask in [*free, *(x | y for x, y in combinations(free, 2) if (x | y) >> CHAIN_SHIFT & ((x | y) >> CHAIN_SHIFT) - 1 == 0)]:
        wanted = by_value ^ np.uint64(back(mask))
        at = np.minimum(np.searchsorted(by_value, wanted), len(by_value) - 1)
        hit = np.flatnonzero((by_value[at] == wanted) & (wanted > by_value))
        found.append((order[hit], order[at[hit]]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def link_forest(prints: DataFrame) -> DataFrame:
    """``a, b`` (a > b): edges with the same components as all links between the distinct fingerprints ``fp``."""
    turned = lambda k: F.col("fp") if not k else F.shiftleft("fp", 8 * k).bitwiseOR(F.shiftrightunsigned("fp", 64 - 8 * k))
    signed = [m - (1 << 64) for m in MASKS]
    keys = [turned(k).bitwiseAND(F.lit(signed[h])).bitwiseOR(F.lit(2 * k + h)) for k in range(8) for h in range(2)]
    keyed = prints.select(F.explode(F.array(*keys)).alias("key"), "fp")

    def run(batches):
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []

        def link(key, fp):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                own = fp[s:e]
                a, b = _links(own, int(key[s]) & 15)
                if len(a):
                    root = _roots(len(own), a, b)
                    leaf = np.flatnonzero(root != np.arange(len(own)))
                    edges.append((own[leaf], own[root[leaf]]))

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            fp = np.concatenate([held, batch.column(1).to_numpy()])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            link(key[:last], fp[:last])
            held_key, held = key[last:], fp[last:]
            if edges:
                a, b = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
                edges.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])
        link(held_key, held)
        if edges:
            a, b = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    # Keys in order, each key's fingerprints in order: a task reads them as a stream.
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (root < node) for every node of ``a, b`` (a > b) that isn't the smallest of its component.

    Alternates large-star and small-star steps until each node hangs at one root; each round is written to the shared
    folder. A node of many neighbours never meets them in one task: joins on it can be split, sums are partial.
    """
    now, seen = keep(edges.select("a", "b").distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # large holds a > b only: every larger neighbour now points to the smallest of the neighbourhood.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = keep(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")


def rooted(prints: DataFrame) -> DataFrame:
    """``fp, root`` for each of the distinct fingerprints ``fp``: the smallest fingerprint of its component."""
    linked = components(link_forest(prints)).select(F.col("node").alias("fp"), "root")
    return prints.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; other columns aren't read.

    Rows whose fingerprints differ in at most two bits are linked; ``component_id`` is the smallest id in a row's
    component, null if all its ids are null. Texts without words share fingerprint 0 and link like any other. Equal ids
    are rows of their own. An empty table gives no rows.
    """
    rows = keep(df.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint(F.col(f"`{text}`")).alias("fp")), "fingerprints")
    return rows.select("doc_id", "fp").join(named(rows), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def named(rows: DataFrame) -> DataFrame:
    """``fp, component_id`` for each distinct fingerprint of rows ``doc_id, fp``."""
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = keep(rooted(least.select("fp")).join(least, "fp"), "roots")
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return roots.join(smallest, "root").select("fp", "component_id")
