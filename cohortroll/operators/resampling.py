"""Bootstrap replicates as weights that tasks draw where the rows are.

A test's n rows are dealt in leaves of at most ``LEAF`` by their number. How many of a replicate's n draws fall into each leaf
comes from a tree of binomials over the leaves, whose generators are keyed by test and node, so every task finds the same counts
on its own; within a leaf each draw is a hash of (test, leaf, replicate, draw). Together that is drawing n rows with
replacement. A leaf sends one row of sums for each replicate; weights of rows are neither shuffled nor written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortroll.functions.scalar import hash_int
from cohortroll.operators.glm import sum_array
from cohortroll.session import TASK_ROWS, keep

LEAF = 65_536  # rows in a leaf at most
ROWS = 1 << 25  # rows of a test whose replicates are ranked inside tasks, at most; a task holds some 20 bytes for each
SHARES, SMALL = 64, 1024  # shares of all replicates together, about, and rows of a test for each share at least
MASK = (1 << 32) - 1
# A 32-bit finaliser's two multipliers, and odd steps between replicates and draws.
FIRST, SECOND, REPLICATE, DRAW = 2246822507, 3266489909, 2654435769, 2246822519


def mix32(h: np.ndarray) -> np.ndarray:
    """Spreads 32-bit numbers, held in 64 bits, over all 32-bit numbers."""
    h = h ^ (h >> np.uint64(16))
    h = h * np.uint64(FIRST) & np.uint64(MASK)
    h = h ^ (h >> np.uint64(13))
    h = h * np.uint64(SECOND) & np.uint64(MASK)
    return h ^ (h >> np.uint64(16))


def mix32_column(h: Column) -> Column:
    """The same in 64-bit signed columns; products are put together from halves, so nothing overflows."""
    def times(v: Column, by: int) -> Column:
        low = v.bitwiseAND(F.lit(65535)) * F.lit(by)
        high = F.shiftleft((F.shiftright(v, 16) * F.lit(by)).bitwiseAND(F.lit(65535)), 16)
        return (low + high).bitwiseAND(F.lit(MASK))

    h = h.bitwiseXOR(F.shiftright(h, 16))
    h = times(h, FIRST)
    h = h.bitwiseXOR(F.shiftright(h, 13))
    h = times(h, SECOND)
    return h.bitwiseXOR(F.shiftright(h, 16))


def test_base(seed: int, keys: Sequence[str]) -> Column:
    """The 32-bit number from which all draws of a test start."""
    return F.pmod(hash_int(F.lit(seed), *keys), F.lit(1 << 32))


test_base.__test__ = False


def hits(base: int, replicate: int, n_draws: int, n_rows: int) -> np.ndarray:
    """The rows that a replicate's draws hit in one leaf."""
    start = mix32(np.array([(base + replicate * REPLICATE) & MASK], np.uint64))
    h = mix32((start + np.arange(n_draws, dtype=np.uint64) * np.uint64(DRAW)) & np.uint64(MASK))
    return (h * np.uint64(n_rows) >> np.uint64(32)).astype(np.int64)


def hit_column(base: Column, replicate: Column, draw: Column, n_rows: Column) -> Column:
    """``hits`` of a test of one leaf, as a column."""
    start = mix32_column((base + replicate * F.lit(REPLICATE)).bitwiseAND(F.lit(MASK)))
    h = mix32_column((start + draw * F.lit(DRAW)).bitwiseAND(F.lit(MASK)))
    return F.shiftright(h * n_rows, 32)


def leaf_draws(base: int, n: int, leaf: int, n_boot: int) -> np.ndarray:
    """How many of n draws fall into a leaf of n rows, for each replicate: down the tree of binomials."""
    low, high = 0, -(-n // LEAF)
    count = np.full(n_boot, n, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left_rows, rows = (mid - low) * LEAF, min(high * LEAF, n) - low * LEAF
        left = np.random.Generator(np.random.Philox(key=np.array([base, low << 32 | high], np.uint64))).binomial(count, left_rows / rows)
        if leaf < mid:
            high, count = mid, left
        else:
            low, count = mid, count - left
    return count


def leaf_weights(base: int, n: int, leaf: int, n_boot: int):
    """Each replicate's number, from 1, and the weights of the leaf's rows."""
    rows = min(LEAF, n - leaf * LEAF)
    own = base if leaf == 0 else int(mix32(np.array([(base + leaf * DRAW) & MASK], np.uint64))[0])
    for b, m in enumerate(leaf_draws(base, n, leaf, n_boot).tolist(), 1):
        yield b, np.bincount(hits(own, b, m, rows), minlength=rows)


def by_leaf(numbered: DataFrame, keys: Sequence[str], seed: int, columns: Sequence[str], out: str,
            work: Callable[[int, int, int, np.ndarray], dict]) -> DataFrame:
    """Runs ``work(base, n, leaf, values)`` on every leaf of rows numbered ``__i`` of ``__n`` per test."""
    keys, columns = list(keys), list(columns)
    rows = numbered.select(*keys, (F.col("__i") / LEAF).cast("int").alias("__leaf"), "__i", "__n", test_base(seed, keys).alias("__base"),
                           *[F.col(c).cast("double").alias(c) for c in columns])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        one = pdf.iloc[0]
        got = pd.DataFrame(work(int(one["__base"]), int(one["__n"]), int(one["__leaf"]), pdf[columns].to_numpy(float)))
        for k in reversed(keys):
            got.insert(0, k, pd.Series([one[k]] * len(got), dtype=object if isinstance(one[k], str) else None))
        return got

    kinds = dict(numbered.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), out])
    return rows.groupBy(*keys, "__leaf").applyInPandas(run, schema)


def replicate_sums(numbered: DataFrame, keys: Sequence[str], columns: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """``keys, __b`` and the columns summed over each replicate's draws."""
    columns = list(columns)

    def work(base, n, leaf, values):
        sums = [w @ values for _, w in leaf_weights(base, n, leaf, n_boot)]
        return {"__b": np.arange(1, n_boot + 1), "__s": sums}

    parts = by_leaf(numbered, keys, seed, columns, "__b int, __s array<double>", work)
    total = parts.groupBy(*keys, "__b").agg(sum_array(f"__s[{i}]" for i in range(len(columns))).alias("__s"))
    return total.select(*keys, "__b", *[F.col("__s")[i].alias(c) for i, c in enumerate(columns)])


class RankedTest:
    """A test's rows folded to distinct pairs of values, in the order of x, for replicates that only count.

    A row costs the number of its pair, two bytes or four; the rest is held by pair or by distinct value.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        xs, x_code = np.unique(x, return_inverse=True)
        ys, y_code = np.unique(y, return_inverse=True)
        pairs, pair_of_row = np.unique(x_code.astype(np.int64) * len(ys) + y_code, return_inverse=True)
        self._set(xs, ys, pairs, pair_of_row.astype(pair_kind(len(pairs))))

    @classmethod
    def of_parts(cls, parts: Sequence[tuple[bytes, bytes, bytes, bytes, int]]) -> RankedTest:
        """The same from ``coded_parts`` of consecutive rows, which are never uncoded all at once."""
        xs, ys = (np.unique(np.concatenate([np.frombuffer(p[k]) for p in parts])) for k in (0, 1))
        found = []
        for x, y, x_code, y_code, n in parts:
            key = np.searchsorted(xs, np.frombuffer(x))[codes(x_code, n)] * np.int64(len(ys)) + np.searchsorted(ys, np.frombuffer(y))[codes(y_code, n)]
            own, place = np.unique(key, return_inverse=True)
            found.append((own, place.astype(pair_kind(len(own)))))
        pairs = np.unique(np.concatenate([own for own, _ in found]))
        pair_of_row, at = np.empty(sum(p[4] for p in parts), pair_kind(len(pairs))), 0
        for own, place in found:
            pair_of_row[at:at + len(place)] = np.searchsorted(pairs, own)[place]
            at += len(place)
        test = cls.__new__(cls)
        test._set(xs, ys, pairs, pair_of_row)
        return test

    def _set(self, xs: np.ndarray, ys: np.ndarray, pairs: np.ndarray, pair_of_row: np.ndarray) -> None:
        self.n, self.n_pairs, self.n_y, self.pair_of_row = len(pair_of_row), len(pairs), len(ys), pair_of_row
        self.steps = np.arange(min(LEAF, self.n), dtype=np.uint32) * np.uint32(DRAW)
        x_of_pair, self.y_of_pair = pairs // len(ys), (pairs % len(ys)).astype(np.int32)
        self.x_starts = np.flatnonzero(np.r_[True, np.diff(x_of_pair) > 0])
        n_of = self._counted(lambda at, end: pair_of_row[at:end]).astype(float)
        self.x = xs - np.add.reduceat(n_of, self.x_starts) @ xs / self.n
        self.y = ys - np.bincount(self.y_of_pair, weights=n_of, minlength=len(ys)) @ ys / self.n
        self.xx, self.y_at_pair = self.x * self.x, self.y[self.y_of_pair]

    def _counted(self, hit: Callable[[int, int], np.ndarray]) -> np.ndarray:
        """How often each pair is among ``hit`` of all stretches of rows, several leaves at a time where there are many pairs."""
        leaf = len(self.steps)
        step = leaf * max(self.n_pairs // leaf, 1)
        total = np.zeros(self.n_pairs, np.int64)
        for at in range(0, self.n, step):
            end = min(at + step, self.n)
            if step == leaf:
                total += np.bincount(hit(at, end), minlength=self.n_pairs)
                continue
            some = np.empty(end - at, np.int64)
            for s in range(at, end, leaf):
                some[s - at:s - at + leaf] = hit(s, min(s + leaf, end))
            total += np.bincount(some, minlength=self.n_pairs)
        return total

    def weights(self, base: int, replicate: int) -> np.ndarray:
        """How many of a replicate's draws hit each pair: ``hits`` of all rows, a stretch of draws at a time."""
        start = int(mix32(np.array([(base + replicate * REPLICATE) & MASK], np.uint64))[0])
        room, wide = np.empty_like(self.steps), np.empty(len(self.steps), np.uint64)

        def hit(at: int, end: int) -> np.ndarray:
            n = end - at
            h, other, row = self.steps[:n] + np.uint32((start + at * DRAW) & MASK), room[:n], wide[:n]
            for shift, by in ((16, FIRST), (13, SECOND)):
                h ^= np.right_shift(h, np.uint32(shift), out=other)
                h *= np.uint32(by)
            h ^= np.right_shift(h, np.uint32(16), out=other)
            np.multiply(h, np.uint64(self.n), out=row, dtype=np.uint64)
            row >>= np.uint64(32)
            return self.pair_of_row[row.view(np.int64)]

        return self._counted(hit)

    def trend(self, base: int, replicate: int) -> tuple[float, float] | None:
        """Slope and rank correlation of a replicate; none with fewer than three distinct x or y."""
        w = self.weights(base, replicate).astype(float)
        of_x = np.add.reduceat(w, self.x_starts)
        of_y = np.bincount(self.y_of_pair, weights=w, minlength=self.n_y)
        if np.count_nonzero(of_x) < 3 or np.count_nonzero(of_y) < 3:
            return None
        rx, ry = (np.cumsum(of) - (of - 1) / 2 - (self.n + 1) / 2 for of in (of_x, of_y))  # less the mean rank
        spread = (of_x @ (rx * rx)) * (of_y @ (ry * ry))
        both = rx @ np.add.reduceat(w * ry[self.y_of_pair], self.x_starts)
        sum_x = of_x @ self.x
        xx = of_x @ self.xx - sum_x * sum_x / self.n
        xy = self.x @ np.add.reduceat(w * self.y_at_pair, self.x_starts) - sum_x * (of_y @ self.y) / self.n
        return xy / xx if xx > 0 else np.nan, both / np.sqrt(spread) if spread > 0 else np.nan


def pair_kind(n: int) -> type:
    """The smallest type that numbers n things."""
    return np.uint16 if n <= 1 << 16 else np.int32


def codes(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.int32)


def coded_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per test and bucket: its rows in order as numbers of the distinct values of x and y."""
    told = [b for b in batches if b.num_rows]
    if not told:
        return
    table = pa.Table.from_batches(told)
    test, bucket, h, x, y = (table[c].to_numpy() for c in ("__t", "__bucket", "__h", "__x", "__y"))
    order = np.lexsort((h, test, bucket))
    test, bucket, h = test[order], bucket[order], h[order]
    change = np.r_[True, (np.diff(test) != 0) | (np.diff(bucket) != 0)]
    tied = np.flatnonzero(~change[1:] & (np.diff(h) == 0))
    if len(tied):  # rows of one hash, rare: in the order of their ids
        first = tied[np.r_[True, np.diff(tied) > 1]]
        last = tied[np.r_[np.diff(tied) > 1, True]] + 1
        for a, z in zip(first.tolist(), last.tolist()):
            ids = table["__id"].take(pa.array(order[a:z + 1])).to_pylist()
            order[a:z + 1] = order[a:z + 1][sorted(range(len(ids)), key=lambda k: ids[k].encode())]
    x, y, starts = x[order], y[order], np.flatnonzero(change)
    out = []
    for a, z in zip(starts, np.append(starts[1:], len(order))):
        row = [int(test[a]), int(bucket[a]), int(z - a)]
        for values in (x[a:z], y[a:z]):
            known, place = np.unique(values, return_inverse=True)
            row += [known.tobytes(), place.astype(pair_kind(len(known))).tobytes()]
        out.append(row)
    kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["__t", "__bucket", "n", "xs", "x", "ys", "y"])


def replicate_trends(numbered: DataFrame, keys: Sequence[str], x: str, y: str, n_boot: int, seed: int) -> DataFrame:
    """``keys, slope, rho`` of every usable replicate of tests of at most ``ROWS`` rows, numbered ``__i`` of ``__n`` per test."""
    rows = numbered.select(*keys, (F.col("__i") / LEAF).cast("bigint").alias("__bucket"), F.col("__i").cast("bigint").alias("__h"),
                           F.lit("").alias("__id"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    return ranked_trends(rows, test_sizes(numbered, keys, seed), keys, n_boot)


def test_sizes(rows: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """One row per test: its number ``__t``, its rows ``__n`` and the start of its draws."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return keep(sizes.select(*keys, "__n", F.monotonically_increasing_id().alias("__t"), test_base(seed, keys).alias("__base")), "tests")


test_sizes.__test__ = False


def ranked_trends(rows: DataFrame, tests: DataFrame, keys: Sequence[str], n_boot: int) -> DataFrame:
    """``keys, slope, rho`` of every usable replicate; ``rows`` have ``__x``, ``__y`` and their order: ``__bucket``, ``__h``, ``__id``.

    A replicate's ranks need all rows of its test in order, so a test's rows go to each task that has a share of its
    replicates, as numbers of distinct values, not as rows. Shares go by size: a test has as many of the ``SHARES`` as its part
    of all rows, so what is sent stays a fixed multiple of the rows, and a test with most of them isn't one task.
    """
    keys = list(keys)
    total = tests.agg(F.sum("__n")).first()[0] or 0
    shares = F.least(F.ceil(F.lit(SHARES) * F.col("__n") / F.lit(max(total, 1))), F.ceil(F.col("__n") / SMALL), F.lit(n_boot).cast("bigint"))
    tests = tests.withColumn("__shares", F.greatest(shares, F.lit(1)))
    groups = tests.agg(F.sum("__shares")).first()[0] or 1
    placed = rows.join(tests.select(*keys, "__t"), keys) if keys else rows.join(tests.select("__t"))
    placed = placed.select("__t", "__bucket", "__h", "__id", F.col("__x").cast("double"), F.col("__y").cast("double"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    parts = placed.repartition(tasks, "__bucket").mapInArrow(
        coded_parts, "__t bigint, __bucket bigint, n bigint, xs binary, x binary, ys binary, y binary")
    sent = parts.join(tests.select("__t", "__base", "__shares"), "__t").withColumn(
        "__share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__shares") - 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        pdf = pdf.sort_values("__bucket")
        test = RankedTest.of_parts(list(zip(pdf["xs"], pdf["ys"], pdf["x"], pdf["y"], pdf["n"].tolist())))
        found = [test.trend(int(one["__base"]), b) for b in range(int(one["__share"]) + 1, n_boot + 1, int(one["__shares"]))]
        found = np.array([f for f in found if f is not None], float).reshape(-1, 2)
        return pd.DataFrame({"__t": np.full(len(found), one["__t"], np.int64), "slope": found[:, 0], "rho": found[:, 1]})

    # Shares are few bytes and long work: their tasks are made by number.
    out = sent.repartition(int(min(2 * groups, 4 * SHARES)), "__t", "__share").groupBy("__t", "__share").applyInPandas(
        run, "__t bigint, slope double, rho double").join(tests.select(*keys, "__t"), "__t")
    return out.select(*keys, *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in ("slope", "rho")])
