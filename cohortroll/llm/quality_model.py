"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed once for every document, whole, and written to the shared folder. The trees are fitted on a bounded
sample of labelled documents and flattened into arrays, which tasks walk for many documents at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortroll.llm.common import bounded_sample, narrow
from cohortroll.session import keep

SAMPLE = 20_000  # labelled rows that the trees are fitted on at most: those with the smallest hash of their id
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
MIN_ROWS = 20
PENALTY = 1.0
SLICE = 2_000_000  # bytes of a text whose words are held at once
SPACE, LINE = re.compile(rb"[ \t-\r]"), re.compile(rb"[^\n]+")

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "word_spread", "distinct_words", "distinct_windows", "top_word", "capitals",
    "digits", "spaces", "line_ends", "high_bytes", "sentence_ends", "commas", "doubled_marks", "bars", "hashes", "symbols",
    "distinct_lines", "line_words", "long_words", "short_words", "byte_entropy", "capital_words",
]
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_MARKS = {"sentence_ends": b".!?", "commas": b",;:", "bars": b"|", "hashes": b"#", "symbols": b"$%&*+<=>@[]^_`{}~/\\"}


def word_slices(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some ``SLICE`` bytes of it at a time, cut where no word is."""
    start = 0
    while len(data) - start > SLICE:
        end = SPACE.search(data, start + SLICE)
        stop = end.start() if end else len(data)
        yield data[start:stop].split()
        start = stop
    yield data[start:].split()


def _hashes(items: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes that tell apart what stands in one text; they differ from one process to the next."""
    return np.fromiter(map(hash, items), np.int64)


def statistics(text: str | None) -> list[float]:
    """One value for each of ``STATISTICS``, all of the whole text: words, windows of three and lines are counted by their hashes."""
    data = (text or "").encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    hist, size = np.zeros(256, np.int64), max(len(raw), 1)
    doubled = 0
    for k in range(0, len(raw), SLICE):
        part = raw[k:k + SLICE + 1]  # one byte more, for the pair across the cut
        hist += np.bincount(part[:SLICE], minlength=256)
        doubled += int((_MARK[part[1:]] & (part[1:] == part[:-1])).sum())
    hashes = []
    n = long = short = total = squares = capitals = 0
    for words in word_slices(data):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        hashes.append(_hashes(words))
        n += len(words)
        total, squares = total + int(lengths.sum()), squares + int((lengths * lengths).sum())
        long, short = long + int((lengths > 15).sum()), short + int((lengths < 3).sum())
        capitals += sum(65 <= w[0] <= 90 for w in words)
    h = np.concatenate(hashes).view(np.uint64)
    _, counts = np.unique(h, return_counts=True)
    three = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] if n > 2 else h[:0]
    lines = _hashes(m.group() for m in LINE.finditer(data) if m.group().strip())
    share = hist[hist > 0] / size
    of = {k: hist[list(v)].sum() / size for k, v in _MARKS.items()}
    many, mean = max(n, 1), total / max(n, 1)
    return [float(v) for v in (
        np.log1p(len(data)), np.log1p(n), mean, np.sqrt(max(squares / many - mean * mean, 0.0)), len(counts) / many,
        len(np.unique(three)) / (n - 2) if n > 2 else 1.0, counts.max(initial=0) / many, hist[65:91].sum() / size,
        hist[48:58].sum() / size, (hist[32] + hist[9]) / size, hist[10] / size, hist[128:].sum() / size, of["sentence_ends"], of["commas"],
        doubled / size, of["bars"], of["hashes"], of["symbols"], len(np.unique(lines)) / max(len(lines), 1), n / max(len(lines), 1),
        long / many, short / many if n else 1.0, -(share * np.log2(share)).sum(), capitals / many)]


def document_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``x array<float>``, the statistics of each whole text; null texts count as empty."""

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1, len(STATISTICS))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    frame = narrow(df, doc_id=doc_id, text=text)
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, x array<float>")


@dataclass
class Trees:
    """All trees in flat arrays: an inner node sends a row right if its statistic is above the threshold; leaves point to themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                above = x[rows, self.feature[node]] > self.threshold[node]
                node = np.where(above, self.right[node], self.left[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts the logistic loss. With one class or no rows there are no trees, only the share of ones (a half without rows)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    none = np.zeros(0, np.int64)
    if len(np.unique(y)) < 2:
        return Trees(base, none, none, np.zeros(0), none, none, np.zeros(0))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(width)]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1)  # bin <= k if x <= edge k
    cell = bins + np.arange(width) * BINS
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf():
        feature.append(0), threshold.append(np.inf), value.append(0.0)
        left.append(len(left)), right.append(len(right))
        return len(left) - 1

    total = np.full(n, base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(leaf())
        place = np.full(n, roots[-1])
        nodes = [roots[-1]]
        for _ in range(DEPTH):
            slot = np.full(len(left), -1)
            slot[nodes] = np.arange(len(nodes))
            live = slot[place] >= 0
            at = (slot[place[live]][:, None] * (width * BINS) + cell[live]).ravel()
            shape = (len(nodes), width, BINS)
            g, h, c = (np.bincount(at, np.repeat(w[live], width), int(np.prod(shape))).reshape(shape).cumsum(2) for w in (gradient, weight, np.ones(n)))
            g_all, h_all, c_all = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + PENALTY) + (g_all - g)**2 / (h_all - h + PENALTY) - g_all**2 / (h_all + PENALTY)
            gain[(c < MIN_ROWS) | (c_all - c < MIN_ROWS)] = 0
            best = gain.reshape(len(nodes), -1).argmax(1)
            following = []
            for node, k, b in zip(nodes, range(len(nodes)), best.tolist()):
                f, cut = divmod(b, BINS)
                if gain[k, f, cut] <= 1e-9 or cut >= len(edges[f]):
                    continue
                a, z = leaf(), leaf()
                feature[node], threshold[node], left[node], right[node] = f, edges[f][cut], a, z
                own = place == node
                place[own] = np.where(bins[own, f] <= cut, a, z)
                following += [a, z]
            nodes = following
            if not nodes:
                break
        g, h = np.bincount(place, gradient, len(left)), np.bincount(place, weight, len(left))
        for node in np.unique(place):
            value[node] = RATE * g[node] / (h[node] + PENALTY)
        total += np.array(value)[place]
    return Trees(base, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


def predict(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out_fold: int = 2, folds: int = 4, cut: float = 0.7,
            sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document row.

    Labels are learned from ids outside the fold only, at most ``sample`` of them; an id with several labels has the
    label of most (1 in a tie), null labels are none. Null ids are neither learned from nor held out. Null and empty texts have a
    score like any other; texts of any length are whole, by the same definitions. Repeated rows have equal scores. Other columns
    of either table, whatever their names, aren't read. An empty table gives no rows.
    """
    known = keep(document_statistics(docs, doc_id, text), "statistics")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    one = narrow(labels, doc_id="doc_id", y=label).where("doc_id is not null and y is not null").groupBy("doc_id").agg(
        (F.avg("y") >= 0.5).cast("int").alias("y")).where(crc != held_out_fold)
    labelled = keep(known.join(one, "doc_id").select("doc_id", "x", "y"), "labelled")
    rows = bounded_sample(labelled, "doc_id", sample).toPandas()
    x = np.stack(rows.x.to_list()).astype(np.float32) if len(rows) else np.zeros((0, len(STATISTICS)), np.float32)
    trees = fit(x, rows.y.to_numpy(float))

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x))], ["doc_id", "score"])

    kind = known.schema["doc_id"].dataType.simpleString()
    scored = known.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(crc == held_out_fold, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
