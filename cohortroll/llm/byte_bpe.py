"""Byte-level BPE by merge replay, and its inverse.

A task replays the merges over the distinct words of many documents at once: an inverted index maps each token pair,
named by the rank of the token that it makes, to the positions where it stands; ranks come off a heap in order, each is
applied at all its positions, and only the neighbours of a merged position enter the index anew. Words that a worker has
seen are kept in a bounded table, so each worker replays the corpus' distinct words, not its running text, and nothing
is shuffled or collected.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cohortroll.llm.common import WordTable, narrow, per_worker, ragged, text_slices, texts_of


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes batches of words with one pass over the merges that occur in them."""

    SHIFT = 20  # bits of an id

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        # Every pair of tokens that makes a token.
        self.pairs = {ranks[t[:k]] << self.SHIFT | ranks[t[k:]]: rank for t, rank in ranks.items()
                      for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        get = self.pairs.get
        self.first = np.array([[get(a << self.SHIFT | b, -1) for b in self.single] for a in self.single])
        self.byte_id = np.array(self.single)

    def encode_all(self, words: list[bytes], at_once: int = 5_000) -> list[list[int]]:
        """The same in parts whose positions stay near one another in memory."""
        return [ids for k in range(0, len(words), at_once) for ids in self.encode(words[k:k + at_once])]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: its own id if it is a token, else the lowest rank merges first, leftmost first."""
        ranks, shift, get = self.ranks, self.SHIFT, self.pairs.get
        out = [None if w not in ranks else [ranks[w]] for w in words]
        cut = [w for w, own in zip(words, out) if own is None]
        text = np.frombuffer(b"".join(cut), np.uint8)
        if not len(text):
            return [own or [] for own in out]
        ends = np.cumsum([len(w) for w in cut])
        starts = np.concatenate([[0], ends[:-1]])
        ids = self.byte_id[text].tolist()
        after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        after[ends[ends > starts] - 1] = -1
        before[starts[ends > starts]] = -1
        made = np.where(after[:-1] > 0, self.first[text[:-1], text[1:]], -1)
        after, before = after.tolist(), before.tolist()
        places = np.argsort(made, kind="stable")
        places = places[np.searchsorted(made[places], 0):]
        found, at = np.unique(made[places], return_index=True)
        index = dict(zip(found.tolist(), (x.tolist() for x in np.split(places, at[1:]))))
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            places = index.pop(rank)
            places.sort()
            for k, p in enumerate(places):
                q = after[p]
                if q < 0 or get(ids[p] << shift | ids[q]) != rank:
                    continue  # a neighbour was merged in the meantime
                ids[p], ids[q] = rank, -1
                right = after[p] = after[q]
                left = before[p]
                lower = False
                if right >= 0:
                    before[right] = p
                    new = get(rank << shift | ids[right])
                    if new is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(heap, new)
                        lower = new < rank
                if left >= 0:
                    new = get(ids[left] << shift | rank)
                    if new is not None:
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            heappush(heap, new)
                        lower = lower or new < rank
                if lower and k + 1 < len(places):  # the new pair goes first; the other places wait
                    index[rank] = places[k + 1:]
                    heappush(heap, rank)
                    break
        flat = np.array(ids)
        kept = np.concatenate([[0], np.cumsum(flat >= 0)])
        flat = flat[flat >= 0].tolist()
        bounds = zip(kept[starts].tolist(), kept[ends].tolist())
        return [own if own is not None else flat[slice(*next(bounds))] for own in out]


def codec(path: str, pattern: str) -> tuple[WordTable, list[bytes]]:
    """This worker's word table and token table."""

    def make():
        replay = MergeReplay(read_ranks(path))
        table = [replay.token.get(i, b"") for i in range(max(replay.token) + 1)]
        words = WordTable(
            regex.compile(pattern).findall, lambda new: replay.encode_all([w.encode("utf-8", "replace") for w in new]))
        return words, table

    return per_worker(("byte_bpe", path, pattern), make)


def encoded_batches(batches, path: str, pattern: str):
    """``doc_id, ids`` of batches ``doc_id, text``."""
    words, _ = codec(path, pattern)
    for batch in text_slices(batches):
        ids, ends = words.encode_batch(texts_of(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), ragged(ids, ends)], ["doc_id", "ids"])


def decoded_batches(batches, path: str, pattern: str):
    """``doc_id, ids, decoded`` of batches ``doc_id, ids``."""
    _, table = codec(path, pattern)
    for batch in batches:
        lists = batch.column(1)
        texts = [b"".join(map(table.__getitem__, ids)) for ids in _lists(lists)]
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])


def digest_batches(batches):
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of batches ``doc_id, ids, decoded``."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for batch in batches:
        ids = list(_lists(batch.column(1)))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(x) for x in ids], pa.int64()),
            pa.array([sha(" ".join(map(str, x)).encode()) for x in ids], pa.string()),
            pa.array([sha(x or b"") for x in batch.column(2).to_pylist()], pa.string())], DIGESTS)


DIGESTS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def _lists(column: pa.ListArray):
    """Each row's numbers as a list; a null row has none."""
    ends, flat = column.offsets.to_numpy().tolist(), column.values.to_numpy(zero_copy_only=False)
    return (flat[a:b].tolist() for a, b in zip(ends, ends[1:]))


def _kind(frame: DataFrame) -> str:
    return frame.schema["doc_id"].dataType.simpleString()


def encode(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: the byte-level BPE ids of each text by the rank file at ``path``.

    One row per input row, repeated rows included. A null or empty text has no ids; a null id stays null. Texts of any
    length are whole. ``pattern`` cuts a text into the words that merges never join. Other columns are not read.
    """
    frame = narrow(df, doc_id=doc_id, text=text)
    return frame.mapInArrow(lambda batches: encoded_batches(batches, path, pattern), f"doc_id {_kind(frame)}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, ids, decoded binary``: the bytes that each row's ids stand for; a null list gives no bytes."""
    frame = narrow(df, doc_id=doc_id, ids=ids)
    return frame.mapInArrow(lambda batches: decoded_batches(batches, path, pattern), f"doc_id {_kind(frame)}, ids array<int>, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, decodes the ids and gives the digests of both, in one pass through Python; rows as in ``encode``."""

    def run(batches):
        return digest_batches(decoded_batches(encoded_batches(batches, path, pattern), path, pattern))

    frame = narrow(df, doc_id=doc_id, text=text)
    return frame.mapInArrow(run, f"doc_id {_kind(frame)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
