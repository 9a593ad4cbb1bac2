"""Licence scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser.

A text becomes its words, one space between them, and the automaton runs once over that string. A tag phrase starts a
licence expression, which is read from the original text up to the end of its line.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortroll.llm.common import per_worker

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices; they label but don't count as base places.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.ASCII | re.IGNORECASE)
ITEM = re.compile(r"[A-Za-z0-9.+:-]+|[()]")
# From an identifier's start to its label; the longest start counts.
FAMILIES = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "mpl": "mpl", "epl": "epl",
    "isc": "isc", "zlib": "zlib", "bsl": "bsl", "unlicense": "unlicense", "cc0": "cc0", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc",
    "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd",
}
STRENGTH = {"with": 3, "and": 2, "or": 1}

# Every byte below 128 that isn't a letter or digit becomes a space, capitals become small; all other bytes stay.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def evaluate(expression: str) -> set[str] | None:
    """The labels that hold under a licence expression; None if it isn't one.

    ``and`` needs both sides, ``or`` allows either, so both keep their labels; ``with`` keeps the licence and drops the
    exception. Operators bind in the order with, and, or, and group to the left. Reading stops at the first item that
    can't follow, if what came before is whole (comment ends and prose often follow on the line).
    """
    items = ITEM.findall(expression)
    output: list[str] = []
    waiting: list[str] = []
    operand = True  # an identifier or an opening bracket may come next
    for item in items:
        word = item.lower()
        if operand:
            if word == "(":
                waiting.append(word)
            elif word in STRENGTH or word == ")":
                return None
            else:
                output.append(item)
                operand = False
        elif word in STRENGTH:
            while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= STRENGTH[word]:
                output.append(waiting.pop())
            waiting.append(word)
            operand = True
        elif word == ")":
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting:
                break
            waiting.pop()
        else:
            break
    if operand or "(" in waiting:
        return None
    output.extend(reversed(waiting))
    stack: list[set[str]] = []
    for item in output:
        if item in STRENGTH:
            right, left = stack.pop(), stack.pop()
            stack.append(left if item == "with" else left | right)
        else:
            stack.append({label_of(item)})
    return stack.pop()


def label_of(identifier: str) -> str:
    """The family of a licence identifier, or its own small letters."""
    small = identifier.lower().rstrip("+")
    starts = [s for s in FAMILIES if small == s or small.startswith((s + "-", s + "+"))]
    return FAMILIES[max(starts, key=len)] if starts else small


def automaton() -> ahocorasick.Automaton:
    """This worker's automaton over all phrases, each between spaces: (phrase's length, label, kind)."""

    def make():
        a = ahocorasick.Automaton()
        for kind, phrases in (("notice", NOTICES), ("base", BASE), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                a.add_word(f" {phrase} ", (len(phrase) + 2, label, kind))
        a.make_automaton()
        return a

    return per_worker(("licences",), make)


def scan_text(text: str | None) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score`` of one text; see ``scan``."""
    words = (text or "").encode("utf-8", "replace").translate(PLAIN).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    found = list(automaton().iter(joined))
    if not found:
        return len(words), 0, None, None, "", "", 0.0
    base, notices, tags = [], set(), False
    for end, (size, label, kind) in found:
        if kind == "base":
            base.append((end - size + 1, label))
        elif kind == "notice":
            notices.add(label)
        else:
            tags = True
    tagged, broken = set(), False
    if tags:
        for m in TAG_TEXT.finditer(text):
            got = evaluate(m[1])
            broken |= got is None
            tagged |= got or set()
    base_labels = {label for _, label in base}
    doubt = (0.2 if base_labels else 1) * (0.3 if notices else 1) * (0.02 if tagged else 0.6 if broken else 1)
    places = np.searchsorted(np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32), [p for p, _ in base]) if base else []
    return (len(words), len(base), int(min(places)) if base else None, int(max(places)) if base else None,
            ",".join(sorted(base_labels)), ",".join(sorted(base_labels | notices | tagged)), 1 - doubt)


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` with each text's licence evidence; one row per input row, other columns aren't read.

    Words are runs of ASCII letters and digits (capitals made small) and of any other non-ASCII characters. ``n_base``
    counts every place where a base phrase's words stand in a row; ``first_word`` and ``last_word`` are the smallest and
    largest such start, counted in words from 0, null without one. ``base_labels`` and ``labels`` are distinct, sorted
    and joined by commas, empty without any. ``score`` is the belief that the text states a licence: 0 without evidence,
    near 1 with a readable identifier tag. A null or empty text has no words. Texts of any length are whole.
    """

    @F.pandas_udf(RESULT)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([scan_text(t) for t in texts], columns=[c.split()[0] for c in RESULT.split(", ")])
        return rows.astype({"first_word": "Int64", "last_word": "Int64"})

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), found(F.col(f"`{text}`")).alias("r")).select("doc_id", "r.*")
