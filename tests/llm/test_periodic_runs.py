"""Periodic runs against a plain search of every period, and the query against it on a small table."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from cohortroll.llm import periodic_runs, queries


def plain_runs(w):
    """Every stretch whose words q apart are equal, for every q, with the smallest q of each stretch."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in out.items())


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_the_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(60):
        docs = []
        for _ in range(rng.randint(1, 6)):
            letters, n = "abcde"[:rng.choice([1, 2, 2, 3, 5])], rng.choice([0, 1, 5, 6, 10, 40, 120])
            w = [rng.choice(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                w = w[:n // 2] + w[:rng.randint(1, 6)] * rng.randint(2, 9) + w[n // 2:]
            docs.append(w)
        docs.append(docs[0])  # a repeated document, whose suffixes stand beside the other's
        assert periodic_runs.document_runs(docs) == [plain_runs(w) for w in docs]


def test_runs_of_known_places():
    one = lambda text: periodic_runs.document_runs([text.split()])[0]
    assert one("a a a a a") == [] and one("a a a a a a") == [(0, 6, 1)]
    assert one("x a b a b a b a b y") == [(1, 8, 2)] and one("x a b a b a b a y") == []
    assert one("a b c " * 4 + "a b d") == [(0, 14, 3)]
    assert one("a a a a a a b " * 4) == [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]
    assert periodic_runs.document_runs([]) == [] and periodic_runs.document_runs([[], []]) == [[], []]


def test_long_texts_of_one_word_two_words_and_long_periods():
    assert periodic_runs.document_runs([["a"] * 200_000])[0] == [(0, 200_000, 1)]
    rng = random.Random(1)
    block = [str(rng.randrange(4000)) for _ in range(5_000)]
    assert periodic_runs.document_runs([["x", *block * 20, "y"]])[0] == [(1, 100_000, 5_000)]
    mixed = [rng.choice("ab") for _ in range(4_000)]
    assert periodic_runs.document_runs([mixed])[0] == plain_runs(mixed)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = np.append(rng.integers(0, 3, rng.integers(0, 60)), 99)
        order, steps = periodic_runs.suffix_array(x)
        suffixes = [x[k:].tolist() for k in range(len(x))]
        assert order.tolist() == sorted(range(len(x)), key=suffixes.__getitem__) and steps[-1][order].tolist() == list(range(len(x)))
        same = lambda a, b: next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        want = [-1] + [same(suffixes[a], suffixes[b]) for a, b in zip(order, order[1:])]
        assert periodic_runs.common_prefixes(order, steps).tolist() == want
        near = periodic_runs.NearestSmaller(np.array(want))
        at = np.flatnonzero(np.array(want) > 0)  # bounds are at least 1
        low = np.array(want)[at]
        assert near.right(at, low).tolist() == [next((j for j in range(k + 1, len(x)) if want[j] < want[k]), len(x)) for k in at]
        assert near.left(at, low).tolist() == [next(j for j in range(k - 1, -1, -1) if want[j] < want[k]) for k in at]


def wanted(doc, text):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    w = periodic_runs.WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (-1 if doc is None else doc, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (-1,) * 4),
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_over_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a b " * 9, "a b " * 9, "w " * 130_000, "é\xa0é é\xa0é " * 5]
    texts += [" ".join(rng.choice(["ab", "cd", "e\n"]) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    rows = [(k, t, "runs", 1) for k, t in enumerate(texts)] + [(None, "a " * 8, None, None), (3, "again " * 6, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_runs int")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    null = lambda v: -1 if v is None else v
    got = sorted(tuple(map(null, (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)))
                 for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert [g for g in got if g[0] != 5] == sorted(wanted(k, t) for k, t, _, _ in rows if k != 5)  # 5 is too long for the plain search
    long = next(g for g in got if g[0] == 5)
    assert long[1:6] == (1, 0, 130_000, 1, 130_000_000) and long[7] == hashlib.sha256(b"w").hexdigest()
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(texts))) > 8
    assert periodic_runs.run_digests(frame.limit(0), periodic_runs.planted).count() == 0
    out = {(r.doc_id, r.collapsed): r for r in periodic_runs.find_runs(frame.where("doc_id <= 3")).collect()}
    assert {k for k in out} == {(0, ""), (1, ""), (2, ""), (3, "a b"), (3, "again")}
    assert [tuple(r) for r in out[3, "a b"].runs] == [(0, 18, 2)] and out[3, "a b"].n_words == 18
