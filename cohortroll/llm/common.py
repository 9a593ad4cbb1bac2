"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space of the Unicode property White_Space (fixed values); Python's own class has four more control characters.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

LIST_LIMIT = 100_000  # strings held in one list while a text is cut
BATCH_CHARS = 2_000_000  # bytes of text that are worked on before their rows are sent on
KNOWN_WORDS = 350_000  # a worker's word table is cut down to its frequent words beyond so many words ...
KNOWN_CHARS = 20_000_000  # ... or characters
KEPT_CHARS = 64  # longer words don't stay when a table is cut down


def per_worker(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, made once for each Python worker.

    This package's functions travel to the workers by value, so their module variables start anew with each task; what is
    to outlive a task hangs on a module of the worker's own.
    """
    store = sys.modules.setdefault("cohortroll_worker", types.ModuleType("cohortroll_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that other columns, whatever their names, never meet an operator's own."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """The rows whose key has the smallest hashes, at most ``most``: all rows of a table that has no more.

    In a larger table only hashes up to a bound, with room to spare, are sorted, so that what all tasks
    send on together stays near ``most`` rows.
    """
    hashed, n = F.xxhash64(key), df.count()
    if n > most:
        share = min(1.0, (1.1 * most + 1000) / n)
        df = df.where(hashed <= int(share * 2**64) - 2**63 - (share == 1.0))
    return df.orderBy(hashed, key).limit(most)


def text_slices(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose texts have at most ``limit`` bytes, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """A text column with null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def pieces_of(cut: Callable, text: str) -> Iterator[list[str]]:
    """All matches of a compiled pattern, given as its ``findall``, in lists of bounded length."""
    if len(text) <= LIST_LIMIT:
        yield cut(text)
        return
    found = (m.group() for m in cut.__self__.finditer(text))
    while part := list(islice(found, LIST_LIMIT)):
        yield part


class WordTable:
    """Ids of texts whose words, as ``cut`` (a compiled pattern's ``findall``) finds them, are encoded independently of one another.

    ``encode`` maps a list of distinct words to their lists of ids. The table is bounded and lives as long as its worker,
    so a worker encodes each word once and not once for each document.
    """

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], list[list[int]]]):
        self.cut, self.encode = cut, encode
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self._hold([])

    def _hold(self, words: list[str]) -> None:
        self.code: defaultdict[str, int] = defaultdict(lambda: len(self.code), zip(words, range(len(words))))
        self.uses = np.zeros(len(words), np.int64)
        self.chars = sum(map(len, words))

    def _cut_down(self) -> None:
        """Keeps the words that were used twice or more since the last time, half the table at most."""
        often = np.argsort(-self.uses, kind="stable")[:KNOWN_WORDS // 2]
        words = list(self.code)
        kept = np.array([k for k in np.sort(often[self.uses[often] > 1]).tolist() if len(words[k]) <= KEPT_CHARS], np.int64)
        self.ids, sizes = self._spread(kept)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self._hold([words[k] for k in kept.tolist()])

    def _learn(self) -> None:
        new = list(islice(self.code, len(self.start) - 1, None))
        if new:
            ids = self.encode(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            self.ids = np.concatenate([self.ids, flat])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.chars += sum(map(len, new))
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def _spread(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in their order, and how many each word has."""
        sizes = self.start[codes + 1] - self.start[codes]
        ends = np.cumsum(sizes)
        step = np.repeat(self.start[codes] - ends + sizes, sizes)
        return self.ids[step + np.arange(len(step))], sizes

    def _finish(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._learn()
        self.uses += np.bincount(codes, minlength=len(self.uses))
        out = self._spread(codes)
        if len(self.code) > KNOWN_WORDS or self.chars > KNOWN_CHARS:
            self._cut_down()
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a small batch of texts, and where each text's ids end, after a leading 0."""
        if any(len(t) > LIST_LIMIT for t in texts):
            parts = [[self.encode_part(part) for part in pieces_of(self.cut, t)] for t in texts]
            sizes = [sum(map(len, p)) for p in parts]
            return np.concatenate([np.zeros(0, np.int32), *chain.from_iterable(parts)]), np.cumsum([0, *sizes])
        look = self.code.__getitem__
        codes = [np.fromiter(map(look, words), np.int64, len(words)) for words in map(self.cut, texts)]
        ends = np.cumsum([0, *map(len, codes)])
        ids, sizes = self._finish(np.concatenate([np.zeros(0, np.int64), *codes]))
        return ids, np.concatenate([[0], np.cumsum(sizes)])[ends]

    def encode_part(self, words: list[str]) -> np.ndarray:
        return self._finish(np.fromiter(map(self.code.__getitem__, words), np.int64, len(words)))[0]


def ragged(values: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """Rows ``ends[k]:ends[k + 1]`` of the values as one list column."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
