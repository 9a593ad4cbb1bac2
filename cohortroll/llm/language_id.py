"""Language identification by rank-order profiles of letter n-grams.

A language's profile is the order of its most frequent n-grams, summed over all its documents. A document's own order is
held against each profile: an n-gram costs the difference of its two places, or the profile's length if it isn't there.

Profiles are held in blocks of languages, sparsely: for each n-gram of a block the languages whose profiles have it, and where.
A document is held against one block after the other, with the nearest two distances so far, so there may be any number of
languages.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortroll.llm.common import per_worker, text_slices, texts_of
from cohortroll.session import keep

PROFILE = 400  # n-grams of a profile and of a document's order
BLOCK = 500  # languages whose profiles are held together
SLICE = 500_000  # characters of a text that are held as numbers at once
FLUSH = 1_000_000  # n-grams that a task holds before it sends them on
FAR = 0.05  # share of the learned documents that doesn't count for the bound of a language ...
MARGIN = 0.15  # ... and what the bound leaves beyond the others
GAP = 1  # stands for whatever isn't a letter
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    make = lambda: np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return per_worker(("letters",), make)


def _counted(parts: list[np.ndarray], weights: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    grams = np.concatenate([np.zeros(0, np.int64), *parts])
    if weights is None:
        return np.unique(grams, return_counts=True)
    found, at = np.unique(grams, return_inverse=True)
    return found, np.bincount(at, np.concatenate([np.zeros(0), *weights]), len(found)).astype(np.int64)


def _coded(text: str) -> list[np.ndarray]:
    """The n-grams of one, two and three letters or word ends, as numbers, of a text of bounded length at a time."""
    parts, tail = [], np.full(1, GAP, np.int64)
    for k in range(0, len(text), SLICE):
        code = np.frombuffer(text[k:k + SLICE].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        code = np.where(_letters()[code], code, GAP)
        if k + SLICE >= len(text):
            code = np.append(code, GAP)
        code = np.concatenate([tail, code])
        code = code[np.concatenate([[True], (code[1:] != GAP) | (code[:-1] != GAP)])]
        new, n = code[len(tail):], len(tail)
        pairs = code[n - 1:-1] << 21 | new
        whole = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
        parts += [new[new != GAP], pairs, whole[code[1:-1] != GAP]]
        tail = code[-2:]
    return parts


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct n-grams and how often each occurs; none if it has no letter."""
    if len(text) <= SLICE:
        return _counted(_coded(text))
    # Long texts: slice by slice, so that only distinct n-grams are held.
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = []
    for part in _coded(text):
        held.append(_counted([part]))
        if len(held) >= 12:
            grams, counts = _counted([grams, *(g for g, _ in held)], [counts, *(c for _, c in held)])
            held = []
    return _counted([grams, *(g for g, _ in held)], [counts, *(c for _, c in held)])


@dataclass
class Profiles:
    """One block of profiles. ``names`` and ``grams`` are sorted; ``ends[g]:ends[g + 1]`` are the rows of ``language`` and ``place`` of n-gram g."""

    names: list[str]
    grams: np.ndarray
    ends: np.ndarray
    language: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, names: list[str], grams: np.ndarray, langs: np.ndarray, places: np.ndarray) -> Profiles:
        order = np.argsort(grams, kind="stable")
        found, start = np.unique(grams[order], return_index=True)
        return cls(names, found, np.append(start, len(grams)), np.searchsorted(names, langs[order].astype(str)) if names else langs[order], places[order])

    def identify(self, text: str | None) -> tuple[str, float, float]:
        """The nearest language, and its distance and the next one's as shares of the largest; 1 where there is none."""
        if not text or not self.names:
            return UNKNOWN, 1.0, 1.0
        grams, counts = gram_counts(text)
        if not (len(grams) and (grams < 1 << 21).any()):
            return UNKNOWN, 1.0, 1.0
        own = grams[np.argsort(-counts, kind="stable")[:PROFILE]]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        here = np.flatnonzero(self.grams[at] == own)
        first, sizes = self.ends[at[here]], self.ends[at[here] + 1] - self.ends[at[here]]
        rows = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        nearer = PROFILE - np.abs(self.place[rows] - np.repeat(here, sizes))  # than an n-gram that isn't there
        far = 1 - np.bincount(self.language[rows], nearer, len(self.names)) / (PROFILE * len(own))
        order = np.argsort(far, kind="stable")
        return self.names[order[0]], float(far[order[0]]), float(far[order[1]]) if len(order) > 1 else 1.0


@dataclass
class Model:
    """Blocks of profiles, in the order of their languages' names."""

    blocks: list[Profiles]

    @property
    def names(self) -> list[str]:
        return [name for block in self.blocks for name in block.names]


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Profiles from all rows whose language and text aren't null. Ties go to the smaller n-gram.

    Tasks add up their n-grams before the shuffle. What comes to the driver at a time is one block of profiles.
    """

    def count(batches):
        held: dict[str, list] = {}

        def flushed():
            for name, (grams, counts) in held.items():
                for k in range(0, len(grams), 100_000):
                    part = grams[k:k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part), pa.array(counts[k:k + 100_000])], ["lang", "gram", "n"])
            held.clear()

        for batch in text_slices(batches, limit=1_000_000):
            by_name: dict[str, list] = {}
            for name, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                if len(text) <= SLICE:
                    by_name.setdefault(name, []).extend(_coded(text))
                else:
                    held[name] = _merged(held.get(name), gram_counts(text))
            for name, grams in by_name.items():
                held[name] = _merged(held.get(name), _counted(grams))
            if sum(len(g) for g, _ in held.values()) > FLUSH:
                yield from flushed()
        yield from flushed()

    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    sums = keep(rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = keep(sums.withColumn("place", F.row_number().over(first) - 1).where(F.col("place") < PROFILE).drop("n"), "profiles")
    names = [r.lang for r in top.select("lang").distinct().orderBy("lang").toLocalIterator()]
    blocks = []
    for k in range(0, len(names), BLOCK):
        own = sorted(names[k:k + BLOCK])
        rows = top.where(F.col("lang").between(own[0], own[-1])).toPandas()  # at most PROFILE * BLOCK rows
        blocks.append(Profiles.of(own, rows.gram.to_numpy(np.int64), rows.lang.to_numpy(object), rows.place.to_numpy(np.int64)))
    return Model(blocks)


def bounds(df: DataFrame, profiles: Model, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """For each language of the profiles, the distance beyond which a document is in none of them.

    That is what all but a share of ``FAR`` of the learned documents keep to, of those that are named by their own language,
    in steps of 0.001, and ``MARGIN`` more. A language without such documents has no bound.
    """
    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), identified(F.col(f"`{text}`"), profiles).alias("r"))
    rows = rows.where((F.col("lang") == F.col("r.lang_pred")) & (F.col("r.distance") < 1))
    steps = rows.groupBy("lang", F.floor(F.col("r.distance") * 1000).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang")  # 1,000 rows a language
    steps = steps.withColumns({"upto": F.sum("n").over(own.orderBy("step")), "all": F.sum("n").over(own)})
    enough = steps.where(F.col("upto") >= (1 - FAR) * F.col("all")).groupBy("lang").agg(F.min("step").alias("step"))
    return {r.lang: (r.step + 1) / 1000 + MARGIN for r in enough.collect()}  # one row a language


def _merged(old, new):
    return new if old is None else _counted([old[0], new[0]], [old[1], new[1]])


def identified(text: Column, profiles: Model) -> Column:
    """A struct ``lang_pred, score, distance`` for each text; ``score`` is the margin before the next language (0 to 1).

    A null text, one without letters, and any text under an empty model is ``und`` with score 0 and distance 1. Equal distances go
    to the language whose name comes first.
    """

    def against(block: Profiles) -> Column:
        @F.pandas_udf("lang string, best double, next double")
        def run(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([block.identify(t) for t in texts], columns=["lang", "best", "next"])

        return run.asNondeterministic()(text)  # so that no filter on the result evaluates it again

    def nearer(a: Column, b: Column) -> Column:
        best = F.when((b["best"] < a["best"]) | (a["lang"] == UNKNOWN), b["lang"]).otherwise(a["lang"])
        return F.struct(best.alias("lang"), F.least(a["best"], b["best"]).alias("best"),
                        F.least(F.greatest(a["best"], b["best"]), a["next"], b["next"]).alias("next"))

    found = [against(block) for block in profiles.blocks or [Profiles.of([], *[np.zeros(0, np.int64)] * 3)]]
    # The blocks' findings, and what is nearest of them, each evaluated once.
    nearest = F.aggregate(F.array(*found[1:]), found[0], nearer) if len(found) > 1 else found[0]
    told = F.transform(F.array(nearest), lambda r: F.struct(
        r["lang"].alias("lang_pred"),
        F.when((r["lang"] == UNKNOWN) | (r["next"] <= 0), 0.0).otherwise(1 - r["best"] / r["next"]).alias("score"), r["best"].alias("distance")))
    return told[0]


def fold(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def predict(df: DataFrame, held_out_fold: int = 1, folds: int = 3, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, distance`` for every row, by profiles of the rows outside the fold.

    Null ids are neither learned from nor held out. Repeated rows count, and are named, once each. A tie between languages goes to
    the name that comes first. Texts of any length are whole, counted in slices of bounded size. Other columns aren't read. An
    empty table gives no rows.
    """
    ids = fold(F.col(f"`{doc_id}`"), folds)
    profiles = learn(df.where(ids != held_out_fold), text, lang)
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(ids == held_out_fold, F.lit(False)).alias("held_out"),
                     identified(F.col(f"`{text}`"), profiles).alias("r"))
    return rows.select("doc_id", "held_out", "r.*")
