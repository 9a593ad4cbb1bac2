"""Best-fit packing of token pieces into sequences of fixed capacity.

The plan needs only the histogram of lengths, which has at most ``capacity`` entries however large the corpus is. It
enumerates patterns of a few lengths that fill a sequence, fits how often each repeats by non-negative least squares,
rounds the repeats down, and packs what is left by best fit in decreasing length, many equal pieces at a time. The plan
says for every length which of its pieces, counted from 0, go where; pieces get that number from a count in their own task
plus the counts of the tasks before, so the corpus is neither sorted nor gathered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortroll.llm.common import narrow, ragged, text_slices, texts_of
from cohortroll.llm.library_tokens import library_words
from cohortroll.session import keep

CAPACITY = 4096
GRAIN = 64  # length classes of the patterns
PATTERN_SIZE = 4  # most documents in a pattern


def piece_batches(batches, path: str, end_id: int, capacity: int, with_ids: bool):
    """Pieces of batches ``doc_id, text``; see ``token_pieces``."""
    words = library_words(path, keeps_space=False)
    for batch in text_slices(batches):
        ids, ends = words.encode_batch(texts_of(batch))
        ids = np.insert(ids, ends[1:], end_id)
        bounds = (ends + np.arange(len(ends))).tolist()
        cuts = [(k, n, a - first, a, min(a + capacity, last)) for k, (first, last) in enumerate(zip(bounds, bounds[1:]))
                for n, a in enumerate(range(first, last, capacity))]
        whole = memoryview(ids.astype("<u4").tobytes())
        out = [batch.column(0).take(pa.array([c[0] for c in cuts])),
               pa.array([c[1] for c in cuts], pa.int32()), pa.array([c[2] for c in cuts], pa.int64()),
               pa.array([b - a for *_, a, b in cuts], pa.int64()),
               pa.array([zlib.crc32(whole[4 * a:4 * b]) for *_, a, b in cuts], pa.int64())]
        if with_ids:
            out.append(ragged(ids, np.array([a for *_, a, _ in cuts] + [bounds[-1]])))
        yield pa.RecordBatch.from_arrays(out, [*PIECE, "ids"][:len(out)])


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def piece_schema(frame: DataFrame, with_ids: bool) -> str:
    kind = frame.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids


def token_pieces(df: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids array<int>``: each document's ids, cut.

    Ids are the library's, without special tokens, then ``end_id``; a null or empty text is ``end_id`` alone. Only
    documents of over ``capacity`` ids are cut, every ``capacity`` ids. Repeated rows give repeated pieces.
    """
    frame = narrow(df, doc_id=doc_id, text=text)
    return frame.mapInArrow(lambda batches: piece_batches(batches, path, end_id, capacity, with_ids), piece_schema(frame, with_ids))


# --- the plan, on the driver: its size depends on the capacity alone ---


def patterns(total: int, parts: int) -> list[tuple[int, ...]]:
    """All descending tuples of at most ``parts`` positive integers with the given sum."""
    found = []

    def extend(head, left, room):
        if not left:
            found.append(head)
        elif room:
            for x in range(min(left, head[-1] if head else left), 0, -1):
                if x * room < left:
                    break
                extend((*head, x), left - x, room - 1)

    extend((), total, parts)
    return found


def non_negative_fit(a: np.ndarray, y: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with the least ``|a x - y|``, by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ y).max(initial=0)))
    for _ in range(rounds):
        slope = np.where(free, -np.inf, a.T @ (y - a @ x))
        k = int(slope.argmax())
        if slope[k] <= scale:
            break
        free[k] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                x = z
                break
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x += step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


class Plan:
    """Where the pieces of each length go: for each length, runs of piece numbers.

    A run is (first number, first sequence, offset, pieces in a sequence); its numbers fill sequence after sequence.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN, parts: int = PATTERN_SIZE):
        bad = [n for n in histogram if not 0 < n <= capacity]
        if bad:
            raise ValueError(f"lengths outside 1 to {capacity}: {sorted(bad)[:5]}")
        self.capacity, self.left = capacity, Counter({n: c for n, c in histogram.items() if c > 0})
        self.lengths = sorted(self.left)
        self.groups: list[tuple[int, tuple[tuple[int, int], ...]]] = []  # repeats, ((length, pieces in a sequence), ...)
        opened = self._fit(min(grain, capacity), parts)
        self._best_fit(opened)
        self.n_sequences = sum(repeats for repeats, _ in self.groups)
        self._runs()

    def _largest(self, most: int) -> int:
        """The largest length of at most ``most`` that still has pieces, or 0."""
        k = bisect_left(self.lengths, most + 1)
        while k and not self.left[self.lengths[k - 1]]:
            del self.lengths[k - 1]
            k -= 1
        return self.lengths[k - 1] if k else 0

    def _fit(self, grain: int, parts: int) -> list:
        """Sequences by the fitted patterns: (free room, repeats, lengths)."""
        width = -(-self.capacity // grain)
        classes = np.zeros(grain)
        for n, c in self.left.items():
            classes[-(-n // width) - 1] += c
        made = [p for p in patterns(grain, parts) if all(classes[x - 1] for x in p)]
        if not made:
            return []
        a = np.zeros((grain, len(made)))
        for k, p in enumerate(made):
            for x in p:
                a[x - 1, k] += 1
        times = np.floor(non_negative_fit(a, classes) + 1e-6).astype(int)
        opened = []
        for k in np.argsort([-max(p) for p in made], kind="stable"):
            todo = int(times[k])
            while todo > 0:
                # All but the last from their classes, the last as large as the room allows.
                taken, room = Counter(), self.capacity
                for x in made[k][:-1]:
                    taken[n := self._next(min(x * width, room), taken)] += 1
                    room -= n
                taken[n := self._next(room, taken)] += 1
                room -= n
                if taken[0] or room >= max(1, width // 8):  # the classes have run out; best fit does better with what is left
                    break
                repeats = min(todo, *(self.left[n] // m for n, m in taken.items()))
                for n, m in taken.items():
                    self.left[n] -= repeats * m
                opened.append((room, repeats, tuple(taken.items())))
                todo -= repeats
        return opened

    def _next(self, most: int, taken: Counter) -> int:
        n = self._largest(most)
        while n and self.left[n] <= taken[n]:
            n = self._largest(n - 1)
        return n

    def _best_fit(self, opened: list) -> None:
        """Places the rest, longest first, where it leaves the least room; a new sequence only if no other has room."""
        rooms: dict[int, list] = {}
        for room, repeats, held in opened:
            rooms.setdefault(room, []).append((repeats, held))
        order = sorted(rooms)
        for n in sorted((n for n, c in self.left.items() if c), reverse=True):
            count = self.left[n]
            while count:
                k = bisect_left(order, n)
                if k == len(order):  # open as many sequences as the rest fills
                    per = min(self.capacity // n, count)
                    repeats, room, held, per_one = count // per, self.capacity - per * n, ((n, per),), per
                else:
                    room = order[k]
                    repeats, held = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room], order[k]
                    per_one = min(room // n, max(1, count // repeats))
                    used = min(repeats, count // per_one)
                    if used < repeats:
                        self._put(rooms, order, room, repeats - used, held)
                    repeats, room, held = used, room - per_one * n, (*held, (n, per_one))
                count -= repeats * per_one
                self._put(rooms, order, room, repeats, held)
            self.left[n] = 0
        self.groups = [g for room in order for g in rooms[room]]

    @staticmethod
    def _put(rooms: dict, order: list, room: int, repeats: int, held: tuple) -> None:
        if room not in rooms:
            rooms[room] = []
            order.insert(bisect_left(order, room), room)
        rooms[room].append((repeats, held))

    def _runs(self) -> None:
        runs: dict[int, list] = {}
        number, sequence = Counter(), 0
        for repeats, held in self.groups:
            at = 0
            for n, per in held:
                runs.setdefault(n, []).append((number[n], sequence, at, per))
                number[n] += repeats * per
                at += n * per
            sequence += repeats
        self.runs = {n: np.array(r, np.int64).T for n, r in runs.items()}

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and number."""
        sequence, offset = np.zeros_like(numbers), np.zeros_like(numbers)
        order = np.argsort(lengths, kind="stable")
        found, at = np.unique(lengths[order], return_index=True)
        for n, rows in zip(found.tolist(), np.split(order, at[1:])):
            first, into, where, per = self.runs[n]
            k = np.searchsorted(first, numbers[rows], "right") - 1
            past = numbers[rows] - first[k]
            sequence[rows] = into[k] + past // per[k]
            offset[rows] = where[k] + past % per[k] * n
        return sequence, offset


def numbered_batches(batches, length: str, capacity: int, names: tuple[str, str]):
    """Adds the task's number and each piece's number among the task's pieces of its length, from 0."""
    seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
    for batch in batches:
        n = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(n) and (n.min() < 1 or n.max() > capacity):
            raise ValueError(f"a length outside 1 to {capacity}")
        order = np.argsort(n, kind="stable")
        ordered = n[order]
        numbers = np.empty_like(n)
        numbers[order] = seen[ordered] + np.arange(len(n)) - np.searchsorted(ordered, ordered)
        seen += np.bincount(n, minlength=capacity + 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(numbers)], [*batch.schema.names, *names])


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """The pieces' rows with ``sequence_id`` and ``offset``: no sequence holds over ``capacity``, none has a gap.

    ``length`` is a whole number from 1 to ``capacity``; null or other values fail. Sequences are numbered from 0. Input
    columns stay, except that one named sequence_id or offset is replaced. The pieces are written to the shared folder
    once, with their numbers. An empty table gives an empty result.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(*[F.col(f"`{c}`") for c in own])
    names = tuple(next(x for k in range(99) if (x := f"_{'_' * k}{c}") not in own) for c in ("task", "number"))
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = rows.mapInArrow(lambda batches: numbered_batches(batches, length, capacity, names), f"{ddl}, {names[0]} int, {names[1]} bigint")
    return _placed(numbered, ddl, length, capacity, names)


def pack_documents(df: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``pack`` of ``token_pieces``, cut and numbered in one pass through Python."""
    frame, names = narrow(df, doc_id=doc_id, text=text), ("_task", "_number")
    ddl = piece_schema(frame, with_ids)

    def run(batches):
        return numbered_batches(piece_batches(batches, path, end_id, capacity, with_ids), "length", capacity, names)

    return _placed(frame.mapInArrow(run, f"{ddl}, _task int, _number bigint"), ddl, "length", capacity, names)


def _placed(numbered: DataFrame, ddl: str, length: str, capacity: int, names: tuple[str, str]) -> DataFrame:
    """Keeps the numbered pieces, plans from their lengths' counts, and looks up each piece's place."""
    task, number = names
    own = [c for c in numbered.columns if c not in names]
    held = keep(numbered, "pieces")
    counts = held.groupBy(F.col(f"`{length}`").cast("bigint").alias("n"), F.col(task).alias("t")).agg(F.count("*").alias("c"))
    before = Window.partitionBy("n").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0)))
    histogram = {r.n: r.c for r in counts.groupBy("n").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` rows
    plan = Plan(histogram, capacity)

    def place(batches):
        for batch in batches:
            n = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = plan.place(n, batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    based = held.join(bases, (F.col(f"`{length}`") == F.col("n")) & (F.col(task) == F.col("t")))
    whole = based.select(*[F.col(f"`{c}`") for c in own], (F.col(number) + F.col("base")).alias(number))
    return whole.mapInArrow(place, f"{ddl}, sequence_id bigint, offset bigint")
