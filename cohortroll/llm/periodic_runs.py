"""Runs of repeated words from an enhanced suffix array, without a tree.

The words of many documents form one sequence in which a mark of its own ends each document. Its suffixes are sorted by
prefix doubling; the ranks of all steps give the LCP array as well. An LCP interval (a stretch of suffixes that begin
with the same ``depth`` words and go on differently) is found by its nearest smaller LCP values; its children are the
stretches between LCP values equal to ``depth``. A square of period ``depth`` that can't be moved to the right begins two
suffixes of one interval, ``depth`` apart, in different children. So at least one of them is not in the largest child: for
each suffix i of the smaller children, ISA[i + depth] and ISA[i - depth] tell whether the partner lies in the interval.
Smaller children hold at most n log n suffixes in all.

Runs are wanted from four periods on, so two more periods to the left must begin in the same interval. Those squares are
moved to the left as far as the words repeat, which gives the run; squares of the same end whose period is a multiple of
a run's that covers them are that run again.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortroll.llm.common import narrow

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BATCH_WORDS = 60_000  # words whose suffixes are sorted together, or those of one document
LEAST = 6  # words in a run
PERIODS = 4  # in a run at least


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes, and for h = 1, 2, 4 ... the place in it of the first suffix with the same h leading codes.

    The sequence ends with a code that stands nowhere else, so equal leading codes never reach beyond its end.
    """
    order = np.argsort(x, kind="stable").astype(np.int32)
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    slots, rank, steps, h = np.arange(len(x), dtype=np.int32), np.zeros(len(x), np.int32), [], 1
    while True:
        rank[order[slots]] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        steps.append(rank.copy())
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = np.flatnonzero(~alone).astype(np.int32)
        if not len(slots):
            return order, steps
        at = order[slots]
        key = rank[at].astype(np.int64) << 32 | rank[at + h]
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]
        new[slots[1:]] |= key[1:] != key[:-1]
        h *= 2


def common_prefixes(order: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """``lcp[k]``: leading codes that the suffixes at places k - 1 and k share; -1 before the first."""
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.full(len(order), -1, np.int32)
    lcp[1:] = 0
    for k in range(len(steps) - 1, -1, -1):
        same = (steps[k][a] == steps[k][b]).astype(np.int32) << k
        a += same
        b += same
        lcp[1:] += same
    return lcp


class NearestSmaller:
    """Nearest places left and right whose value is below a bound of at least 1, by minima over stretches of 1, 2, 4 ... places."""

    def __init__(self, values: np.ndarray):
        self.minima, h = [values], 1
        while len(self.minima[-1]) > h and self.minima[-1].max() > 0:  # longer stretches all hold a 0
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-h], last[h:]))
            h *= 2
        self.n = len(values)

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place after each whose value is below the bound; the length if there is none."""
        p = at + 1
        for k in range(len(self.minima) - 1, -1, -1):
            low = self.minima[k]
            fits = p < len(low)
            fits &= low[np.where(fits, p, 0)] >= bound
            p = p + (fits.astype(p.dtype) << k)
        return p

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place before each whose value is below the bound. Place 0 always is."""
        p = at.copy()
        for k in range(len(self.minima) - 1, -1, -1):
            start = p - (1 << k)
            fits = start >= 0
            fits &= self.minima[k][np.where(fits, np.minimum(start, len(self.minima[k]) - 1), 0)] >= bound
            p = p - (fits.astype(p.dtype) << k)
        return p - 1


def branching_squares(x: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and periods of the squares that can't move right and follow two more periods: all runs of four periods or more."""
    order, steps = suffix_array(x)
    place = steps[-1]
    lcp = common_prefixes(order, steps)
    del steps
    near = NearestSmaller(lcp)
    k = np.flatnonzero((lcp >= 1) & (lcp <= longest // PERIODS))
    depth = lcp[k]
    low, high = near.left(k, depth), near.right(k, depth)
    k, depth, low, high = (a[high - low >= PERIODS] for a in (k, depth, low, high))  # the interval holds places low to high - 1
    if not len(k):
        return k, k
    ends = near.right(k, depth + 1)  # the child that begins at k ends before the next value of at most depth
    first = near.left(k, depth + 1) == low  # no equal value before: the interval's first child ends here as well
    start = np.concatenate([k, low[first]])
    end = np.concatenate([ends, k[first]])
    row = np.concatenate([np.arange(len(k)), np.flatnonzero(first)])
    _, interval = np.unique(low[row] * np.int64(longest + 1) + depth[row], return_inverse=True)
    by = np.lexsort((end - start, interval))
    smaller = by[:-1][interval[by[:-1]] == interval[by[1:]]]  # all but the largest of each interval
    start, end, row = start[smaller], end[smaller], row[smaller]
    size = end - start
    of = np.repeat(np.arange(len(size)), size)
    i = order[start[of] + np.arange(len(of)) - (np.cumsum(size) - size)[of]].astype(np.int64)
    d, lo, hi = depth[row][of].astype(np.int64), low[row][of], high[row][of]

    def within(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        at = place[np.clip(p, 0, len(x) - 1)]
        return (p >= 0) & (p < len(x)) & (at >= lo) & (at < hi)

    found = []
    for shift in (0, 1):  # the smaller child's suffix is the square's first half, or its second
        s = i - shift * d
        hit = np.flatnonzero(within(i + (1 - 2 * shift) * d, lo, hi))
        for back in (1, 2):
            hit = hit[within(s[hit] - back * d[hit], lo[hit], hi[hit])]
        s, period = s[hit], d[hit]
        ahead = x[s + period] != x[s + 2 * period]
        found.append(np.stack([s + 2 * period, period], 1)[ahead])
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1]


def moved_left(x: np.ndarray, start: int, period: int) -> int:
    """The least place from which on all words up to ``start`` equal those one period later."""
    step = 32
    while start > 0:
        to = max(0, start - step)
        differ = np.flatnonzero(x[to:start] != x[to + period:start + period])
        if len(differ):
            return to + int(differ[-1]) + 1
        start, step = to, 2 * step
    return start


def runs_of(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs in a sequence whose documents, of at most ``longest`` words, end with codes of their own."""
    ends, periods = branching_squares(x, longest)
    out = []
    bounds = np.flatnonzero(np.diff(ends, prepend=-1, append=-1)).tolist()
    for a, b in zip(bounds, bounds[1:]):
        end, left = int(ends[a]), periods[a:b]  # rising periods
        while len(left):
            q = int(left[0])
            start = moved_left(x, end - PERIODS * q, q)
            if end - start >= max(LEAST, PERIODS * q):
                out.append((start, end - start, q))
            left = left[1:]
            left = left[(left % q != 0) | (end - PERIODS * left < start)]
    return sorted(out)


def dealt(batches, rewrite: Callable[[object, list[str]], list[str]] | None) -> Iterator[tuple[list, list[list[str]]]]:
    """Ids and words of documents ``doc_id, text``, so many at once that their suffixes are worth sorting together."""
    ids, words, n = [], [], 0
    for batch in batches:
        texts = batch.column(1)
        for k, doc in enumerate(batch.column(0).to_pylist()):
            found = WORD.findall(texts[k].as_py() or "")
            found = rewrite(doc, found) if rewrite else found
            if n and n + len(found) > BATCH_WORDS:
                yield ids, words
                ids, words, n = [], [], 0
            ids.append(doc)
            words.append(found)
            n += len(found) + 1
    if ids:
        yield ids, words


def document_runs(words: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """Each document's runs, in order."""
    codes: defaultdict[str, int] = defaultdict(lambda: len(codes))
    look = codes.__getitem__
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    x = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    for start, w in zip(starts.tolist(), words):
        x[start:start + len(w)] = np.fromiter(map(look, w), np.int64, len(w))
    x[starts + sizes] = len(codes) + np.arange(len(sizes))
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    found = runs_of(x, int(sizes.max(initial=0)))
    owner = np.searchsorted(starts, [r[0] for r in found], "right") - 1
    for k, (start, length, period) in zip(owner.tolist(), found):
        out[k].append((start - int(starts[k]), length, period))
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period."""
    if not runs:
        return " ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return " ".join([words[k] for k in np.flatnonzero(kept).tolist()])


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def run_batches(batches, kind: pa.DataType, rewrite=None):
    """``doc_id, n_words, runs, collapsed``."""
    for ids, words in dealt(batches, rewrite):
        runs = document_runs(words)
        told = [[dict(zip(("start", "length", "period"), r)) for r in one] for one in runs]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array([len(w) for w in words], pa.int64()), pa.array(told, KIND),
             pa.array([collapsed(w, r) for w, r in zip(words, runs)], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def digest_batches(batches, kind: pa.DataType, rewrite=None):
    """Each document's number of runs, its longest run (the first in a tie, then that of the smallest period) and digests."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for ids, words in dealt(batches, rewrite):
        runs = document_runs(words)
        best = [max(one, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3) for one in runs]
        start, length, period = (pa.array([b[k] for b in best], pa.int64()) for k in range(3))
        milli = pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array([len(one) for one in runs], pa.int64()), start, length, period, milli,
             pa.array([sha("".join(f"{s},{n},{q}\n" for s, n, q in one)) for one in runs], pa.string()),
             pa.array([sha(collapsed(w, one)) for w, one in zip(words, runs)], pa.string())],
            ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def planted(doc_id: object, words: list[str]) -> list[str]:
    """The words with a repeated tail in about every tenth document, by the CRC of its decimal id; none without an id."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole = words[a:a + p]
    return words[:a] + (whole * (-(-(n - a) // p)))[:n - a]


def _frame(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    frame = narrow(df, doc_id=doc_id, text=text)
    return frame, frame.schema["doc_id"].dataType.simpleString(), to_arrow_type(frame.schema["doc_id"].dataType)


def find_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the periodic runs of each whole text, and the text with one period of each.

    Words are what white space of ASCII separates, numbered from 0. A run is a stretch of words with smallest period q (words
    q apart are equal) of at least six words and four periods, which no word beside it extends. ``runs`` are sorted by
    start, then period; ``collapsed`` joins by one space the words that no run holds after its first period.

    One row per input row, repeated rows and null ids included. A null text, or one without words, has no runs and an empty
    ``collapsed``. An empty table gives no rows; other columns aren't read. Texts of any length are whole: a text of n words
    takes some 300 bytes a word while it is worked on. Nothing is shuffled or collected.
    """
    frame, name, kind = _frame(df, doc_id, text)
    return frame.mapInArrow(lambda b: run_batches(b, kind), f"doc_id {name}, n_words bigint, runs {RUNS}, collapsed string")


def run_digests(df: DataFrame, rewrite: Callable[[object, list[str]], list[str]] | None = None, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``find_runs`` in one row of numbers and digests a document; ``rewrite`` changes its words beforehand."""
    frame, name, kind = _frame(df, doc_id, text)
    return frame.mapInArrow(
        lambda b: digest_batches(b, kind, rewrite),
        f"doc_id {name}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
