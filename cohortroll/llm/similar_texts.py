"""Groups of texts whose sets of five-word shingles are alike: a Jaccard similarity of at least 0.8, checked exactly.

Candidates come from two sides. Texts whose SimHash fingerprints hang together within two bits are candidates, found by the
pigeonring chain of ``near_dedup``. At a similarity of 0.8 fingerprints differ in about ten bits, which leaves pigeonring keys of
hardly any bits; so texts that share a band of minima are candidates too, of 40 min-hash bands of 8 minima each. A pair of
similarity s shares a band with a chance of 1 - (1 - s ** 8) ** 40: 0.9994 at 0.8, 0.999997 at 0.85.

Of the texts under a band key, each is held against the key's best connected one first, which links most of a large group in
one pass that streams. What then is under one key and not yet in one group meets in blocks of bounded size: every pair of
different groups is compared, found by rarest shingles, and none is left out. A task holds two sets, or two blocks.
"""

from __future__ import annotations

from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortroll.llm.common import text_slices
from cohortroll.llm.near_dedup import components, rooted, simhash
from cohortroll.session import keep

SHINGLE = 5
SIMILAR = (4, 5)  # least similarity, as a fraction
BANDS, ROWS = 40, 8
SEED = 43
PART = 100_000  # shingles that are held as strings at once
AT_ONCE = 2_000  # shingles that meet all min-hash functions at once
SPOKES = 256  # texts that one task holds against one copy of a hub's set, about
BLOCK_BYTES = 8_000_000  # of the texts of a block, about; a longer text is a block's only one


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles.

    Words are those of ``near_dedup.simhash``. Fewer words than a shingle has are one shingle; a text without words, or
    null, has none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, found = max(len(words) - SHINGLE + 1, 1), []
    for k in range(0, n, PART):
        part = words[k:min(k + PART, n) + SHINGLE - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
        found.append(np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, joined, repeat(SEED))), ">u8").astype(np.uint64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@cache
def _factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) << np.uint64(1) | np.uint64(1)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of a set; sets that share a key are candidates. An empty set has none."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), AT_ONCE):
        mixed = own[k:k + AT_ONCE] ^ own[k:k + AT_ONCE] >> np.uint64(31)
        np.minimum(least, (_factors() * mixed).min(1), out=least)
    raw = least.astype("<u8").tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[8 * ROWS * b:8 * ROWS * (b + 1)], b) for b in range(BANDS)], np.uint64).view(np.int64)


def _node(own: np.ndarray) -> int:
    """One signed number for equal sets; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0


def sketched(text: Column) -> Column:
    """A struct ``node, keys, print``: the number of a text's set, its band keys and its fingerprint."""
    @F.pandas_udf("node bigint, keys array<bigint>, print bigint")
    def run(texts: pd.Series) -> pd.DataFrame:
        nodes, prints, keys = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
        for k, text in enumerate(texts):  # one set is held at a time
            own = shingles(text)
            nodes[k] = _node(own)
            keys.append(band_keys(own))
            prints[k] = simhash(text)
        return pd.DataFrame({"node": nodes, "keys": keys, "print": prints})

    return run(text)


def print_keys(sketches: DataFrame) -> DataFrame:
    """``node, key``: a key for each component of fingerprints that hang together within two bits, texts without words aside."""
    known = keep(sketches.where("node <> 0").select("node", F.col("print").alias("fp")).distinct(), "prints")
    roots = rooted(known.select("fp").distinct())
    return known.join(roots, "fp").select("node", F.xxhash64(F.lit(BANDS), "root").alias("key"))


def key_members(sketches: DataFrame) -> DataFrame:
    """``key, node, hub`` for the band and fingerprint keys of two or more nodes; of keys with the same nodes, one stays.

    The hub is the key's node that shares keys with the most others, all its keys taken together.
    """
    keyed = sketches.select("node", F.explode("keys").alias("key")).unionByName(print_keys(sketches))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    every = keep(keyed.join(shared, "key").distinct(), "band-keys")
    sizes = every.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    one = keep(sizes.groupBy("n", "h").agg(F.min("key").alias("key")).select("key", "n"), "distinct-keys")
    members = keep(every.join(one, "key"), "key-members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"))
    return keep(members.join(hubs, "key").select("key", "node", "hub", "n"), "hubs")


def hub_pairs(members: DataFrame) -> DataFrame:
    """``node, hub``: each node with the hub that most of its keys' nodes share, one row a node."""
    best = members.where("node <> hub").groupBy("node", "hub").agg(F.sum("n").alias("n"))
    return best.groupBy("node").agg(F.max(F.struct("n", "hub"))["hub"].alias("hub"))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    up, of = SIMILAR
    if len(a) * of < len(b) * up or len(b) * of < len(a) * up:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * of >= (len(a) + len(b) - both) * up


def _edge(a: Column | str, b: Column | str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def linked_to_hubs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` (a > b) of the pairs ``node, hub`` whose texts (``node, text``, one row a node) are similar.

    A hub's nodes are dealt out to tasks, some 256 with each copy of its text; a task reads them as a stream.
    """
    slots = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPOKES).alias("slots"))
    dealt = keep(pairs.join(slots, "hub").select("hub", F.pmod(F.xxhash64("node"), "slots").alias("slot"), "node"), "spokes")
    spokes = dealt.join(texts, "node").select("hub", "slot", "node", "text")
    heads = dealt.select("hub", "slot").distinct().join(texts.select(F.col("node").alias("hub"), "text"), "hub").select(
        "hub", "slot", F.lit(None).cast("bigint").alias("node"), "text")

    def run(batches):
        own = None
        for batch in text_slices(batches, 3):
            found = []
            for hub, _, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if node is None:
                    own = shingles(text)
                elif alike(own, shingles(text)):
                    found.append((hub, node))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["hub", "node"])

    rows = heads.unionByName(spokes).repartition("hub", "slot").sortWithinPartitions("hub", "slot", F.col("node").asc_nulls_first())
    return rows.mapInArrow(run, "hub bigint, node bigint").select(*_edge("hub", "node"))


def linked_sets(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, within: bool) -> list[tuple[int, int]]:
    """Similar pairs (places) that tie together what of the distinct sets has different roots.

    Two similar sets share one of their rarest shingles: as many as a set can miss, and one more. Pairs that already hang
    together aren't compared, nor pairs of one side unless ``within``.
    """
    sizes, root, links = np.array([len(s) for s in sets]), root.copy(), []
    own = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((code, count[code], own))
    place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    up, of = SIMILAR
    rare = place < np.repeat(sizes - -(-sizes * up // of) + 1, sizes)
    code, own = code[order][rare], own[order][rare]
    order = np.argsort(code, kind="stable")
    code, own = code[order], own[order]
    tried: set[tuple[int, int]] = set()
    for group in np.split(own, np.flatnonzero(np.diff(code)) + 1):
        if len(group) < 2 or (root[group] == root[group[0]]).all():
            continue
        for k in range(1, len(group)):
            b, before = int(group[k]), group[:k]
            fits = (root[before] != root[b]) & ((side[before] != side[b]) | within)
            for a in before[fits].tolist():
                if root[a] != root[b] and (a, b) not in tried:
                    tried.add((a, b))
                    if alike(sets[a], sets[b]):
                        links.append((a, b))
                        root[root == root[b]] = root[a]
    return links


def block_pairs(members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, i, j, block, node, root``: under each key whose nodes have different roots, the pairs of blocks that are to meet.

    The nodes of the key's largest group never meet one another; each block of the others meets every other block.
    """
    rooted = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    sized = keep(rooted.join(open_keys, "key").join(texts.select("node", F.octet_length("text").alias("size")), "node"), "open-keys")
    groups = sized.groupBy("key", "root").agg(F.sum("size").alias("size"))
    largest = groups.groupBy("key").agg(F.max(F.struct("size", "root")).alias("m"), F.sum("size").alias("all"))
    slots = lambda size: F.ceil(size / BLOCK_BYTES).cast("int")
    largest = largest.select("key", F.col("m.root").alias("main"), F.greatest(slots(F.col("m.size")), F.lit(1)).alias("mains"),
                             F.greatest(slots(F.col("all") - F.col("m.size")), F.lit(1)).alias("others"))
    is_main = F.col("root") == F.col("main")
    own = F.when(is_main, F.col("others") + F.pmod(F.xxhash64("node"), "mains")).otherwise(F.pmod(F.xxhash64("node"), "others")).cast("int")
    placed = sized.join(largest, "key").withColumn("block", own).withColumn("main", is_main)
    last = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    met = placed.select("key", "node", "root", "block", "others", F.explode(F.sequence(F.lit(0), last)).alias("with")).where("with <> block")
    return met.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "root", "others")


def linked_in_blocks(met: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` (a > b): similar pairs that tie together the different roots of two blocks' nodes."""

    def run(batches):
        now, held = None, []

        def done():
            _, _, j, others = now
            nodes, roots, blocks, sets = zip(*held)
            links = linked_sets(list(sets), np.array(roots), np.array(blocks), j == others) if len(set(roots)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[pair[k]] for pair in links], pa.int64()) for k in (0, 1)], ["x", "y"])

        for batch in text_slices(batches, 7):
            for key, i, j, block, node, root, others, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j, others) != now and held:
                    yield done()
                    held = []
                now = key, i, j, others
                held.append((node, root, block, shingles(text)))
        if held:
            yield done()

    rows = met.join(texts, "node").select("key", "i", "j", "block", "node", "root", "others", "text")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(run, "x bigint, y bigint").select(*_edge("x", "y"))


def similar_roots(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, root`` for the nodes that hang together with another over similar pairs and aren't the smallest of theirs."""
    to_hubs = keep(linked_to_hubs(hub_pairs(members), texts), "hub-links")
    roots = components(to_hubs)
    in_blocks = keep(linked_in_blocks(block_pairs(members, roots, texts), texts), "block-links")
    return roots if in_blocks.isEmpty() else components(to_hubs.unionByName(in_blocks))
