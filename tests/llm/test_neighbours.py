"""Near-duplicates, nearest neighbours and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cohortroll.llm import language_id, multi_index, near_dedup, packing, similar_texts

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def print_by_hand(text):
    w = SPACED.findall((text or "").translate(SMALL))
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_hand(prints):
    """The smallest place linked to each, over distances of two bits or fewer."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(prints):
        for j in range(k):
            if (a ^ prints[j]).bit_count() <= 2:
                p, q = sorted((find(k), find(j)))
                root[q] = p
    return [find(k) for k in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("seed", range(4))
def test_every_close_pair_shares_a_key_that_keeps_to_the_chain(spark, seed):
    rng = random.Random(seed)
    a = rng.getrandbits(64)
    for bits in [(), (0,), (63,), (7, 8), (0, 63), (31, 32), *[tuple(rng.sample(range(64), 2)) for _ in range(200)]]:
        b = a
        for k in bits:
            b ^= 1 << k
        turn = lambda x, k: (x << 8 * k | x >> (64 - 8 * k)) & (1 << 64) - 1
        shared = [(k, h) for k in range(8) for h in range(2) if turn(a ^ b, k) & near_dedup.MASKS[h] == 0 and (turn(a ^ b, k) >> 8).bit_count() <= 1]
        assert shared
        if bits:
            k, h = shared[0]
            x, y = near_dedup._links(np.array([signed(a), signed(b)]), 2 * k + h)
            assert x.tolist() == [0] and y.tolist() == [1]


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\x0b", "One", "one TWO", "one two  three", "a b c a b c", "\xa0 \x1c É é", "x " * 250_000] + [" ".join(str(rng.randint(0, 30)) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("fp", F.lit("own"))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    prints = [print_by_hand(t) for t in texts]
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k].component_id for k in range(len(texts))] == classes_by_hand(prints)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_crowds_and_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRED", 16)
    rng = random.Random(8)
    prints = [0, 0, (1 << 64) - 1]
    step = rng.getrandbits(64)
    for k in range(40):  # a chain of links whose ends are far apart
        prints.append(step)
        step ^= 1 << k
    crowd = rng.getrandbits(64)  # many distinct fingerprints that share their upper bits
    prints += [crowd ^ rng.getrandbits(9) for _ in range(200)] + [rng.getrandbits(64) for _ in range(100)]
    rng.shuffle(prints)
    want = classes_by_hand(prints)
    # The last columns: a null id never names a class that has another id.
    rows = spark.createDataFrame([(k, signed(p)) for k, p in enumerate(prints)] + [(None, signed(prints[5]))], "doc_id bigint, fp bigint").repartition(5)
    got = {r.fp: r.component_id for r in near_dedup.named(rows).collect()}
    assert [got[signed(p)] for p in prints] == want


def test_forest_is_as_small_as_its_nodes(spark):
    base = random.Random(1).getrandbits(64)
    prints = sorted({signed(base ^ k) for k in range(300)})
    edges = near_dedup.link_forest(spark.createDataFrame([(p,) for p in prints], "fp bigint"))
    assert edges.count() <= 16 * len(prints)


# --- neighbours ---


def test_visit_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    first, second, counts = rng.random(5), rng.random(7), rng.integers(0, 4, (5, 7))
    cells = multi_index.visit(first, second, counts, 10**9)
    sums = [first[i] + second[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == set(zip(*map(list, np.nonzero(counts))))
    few = multi_index.visit(first, second, counts, 9)
    assert few == cells[:len(few)] and counts[tuple(zip(*few))].sum() >= 9 > counts[tuple(zip(*few[:-1]))].sum()


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(k), None if v is None else [None if c is None else float(c) for c in v], "own") for k, v in zip(ids, x)], "vec_id bigint, embedding array<float>, rank string").repartition(3)


def neighbours_by_hand(x, ids, k=20, every=20):
    x = np.asarray(x, np.float32).astype(float)
    out = {}
    for a, q in zip(ids, x):
        if a % every == 0:
            s = x @ q
            out[a] = sorted((-v, b) for v, b in zip(s, ids) if b != a)[:k]
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(2)
    x = [*rng.normal(size=(300, 8)), *([[0.5] * 8] * 60)]
    bad = [None, [0.0] * 8, [1.0, None, *[1.0] * 6], [float("nan")] * 8, [float("inf")] * 8, [1.0] * 5, []]
    df = vectors(spark, [*x, *bad], [*range(len(x)), *range(1000, 1000 + 20 * len(bad), 20)])
    want = neighbours_by_hand(x, range(len(x)))
    got = {}
    for r in multi_index.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    for q, rows in got.items():
        assert [r[0] for r in sorted(rows)] == list(range(1, 21))
        assert np.allclose([s for _, _, s in sorted(rows)], [-s for s, _ in want[q]], atol=1e-12)
        ties = {round(-s, 9) for s, _ in want[q]}
        if len(ties) == 20 or q >= 300:
            assert [v for _, v, _ in sorted(rows)] == [v for _, v in sorted(want[q], key=lambda p: (round(p[0], 9), p[1]))]
    few = {r.query_id: r for r in multi_index.search(vectors(spark, x[:7])).collect()}
    assert multi_index.search(vectors(spark, x[:7])).count() == 6 and set(few) == {0}
    assert multi_index.search(vectors(spark, x[:1])).count() == 0
    assert multi_index.search(df.limit(0)).count() == 0


def test_recall_and_split_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 60)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = neighbours_by_hand(x, range(len(x)))
    rows = multi_index.search(vectors(spark, x), least=1, centroids=12).collect()
    hit = Counter()
    for r in rows:
        hit[r.query_id] += r.vec_id in {v for _, v in want[r.query_id]}
    assert len(rows) == 20 * len(want) and sum(hit.values()) >= 0.9 * len(rows)


# --- pipeline ---


def passed_on(spark, stage, docs):
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    return out


def test_pipeline_stages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "to", "mi", "ru", "ne"]) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(90)) for _ in range(25)]
    rows = [(k, t, "aa", "s", 1, "own") for k, t in enumerate(base)]
    rows += [(100 + k, base[k], "aa", "s", 1, "own") for k in range(6)] * 2  # copies, repeated as rows
    rows += [(3, base[3], "aa", "s", 2, "own"), (None, base[4], "aa", None, 1, "own"), (None, "x " * 100 + base[9], None, "s", 1, "own")]
    rows += [(200, None, "aa", "s", 1, "own"), (201, "", "aa", "s", 1, "own"), (202, "too short", "aa", "s", 1, "own"), (203, "same words here " * 60, "aa", "s", 1, "own"), (204, "12 34 56 78 90 " * 3 + " ".join(map(str, range(900))), "aa", "s", 1, "own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words bigint, _failed string").repartition(3)
    judged = passed_on(spark, corpus_pipeline.quality_stage, docs)
    gone = Counter(map(tuple, docs.collect())) - Counter(map(tuple, judged.collect()))
    assert {r[0] for r in gone} == {200, 201, 202, 203, None} and sum(gone.values()) == 5
    named = passed_on(spark, corpus_pipeline.language_stage, judged)
    gone = Counter(map(tuple, judged.collect())) - Counter(map(tuple, named.collect()))
    assert {r[0] for r in gone} == {204}
    left = [tuple(r) for r in passed_on(spark, corpus_pipeline.near_dedup_stage, named).collect()]
    held = [tuple(r) for r in named.collect()]
    of = classes_by_hand([print_by_hand(r[1]) for r in held])
    first = {}
    for row, c in zip(held, of):
        first[c] = min(first.get(c, (True, 0)), (row[0] is None, row[0] or 0))
    assert len(left) == len(set(of)) and len(set(left)) == len(left)
    kept = {of[held.index(row)]: (row[0] is None, row[0] or 0) for row in left}
    assert kept == first
    packed = corpus_pipeline.packing_stage(spark, named, "").collect()
    assert len(packed) == len(held) and max(r.offset + r.length for r in packed) <= packing.CAPACITY
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def sets_by_hand(text):
    w = SPACED.findall((text or "").translate(SMALL))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("spokes, block", [(similar_texts.SPOKES, similar_texts.BLOCK_BYTES), (2, 1200)])
def test_near_dedup_stage_is_shingle_similarity(spark, monkeypatch, spokes, block):
    monkeypatch.setattr(similar_texts, "SPOKES", spokes)
    monkeypatch.setattr(similar_texts, "BLOCK_BYTES", block)  # groups of copies are cut into many blocks
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(30)]
    rows, own = [], lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    for _ in range(60):
        words = own(rng.randint(60, 300)) + passage  # a passage that all share
        rows.append(words)
        for _ in range(rng.randint(0, 3)):  # edits chain, and some go below the bound
            words = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = own(1)[0].upper()
            rows.append(words)
    for n, edits in ((40, 2), (30, 3)):  # many alike, around a text that isn't there
        base = own(150)
        for _ in range(n):
            words = list(base)
            for k in rng.sample(range(150), edits):
                words[k] = own(1)[0].upper()
            rows.append(words)
    texts = [" ".join(w) for w in rows] + [None, "", " \t", "Short text", "short  TEXT", "another one"]
    sets = [sets_by_hand(t) for t in texts]
    root, near = list(range(len(texts))), 0
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * len(sets[a] | sets[b]):
                near += sets[a] != sets[b]
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert near > 40
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id bigint, text string, _node string").repartition(3)
    left = passed_on(spark, corpus_pipeline.near_dedup_stage, docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(root))


def test_candidates_come_from_fingerprints_too(spark):
    """Texts that share no band but whose fingerprints hang together within two bits meet under one key."""
    at = 0x0123456789ABCDEF
    prints = {1: at, 2: at ^ 3, 3: at ^ 3 ^ 1 << 40 ^ 1 << 62, 4: at ^ 0xFF, 5: ~at, 6: ~at, 7: at, 0: 0}
    rows = [(n, [], f) for n, f in prints.items()] + [(8, [77], 5), (9, [77], 1 << 50)]
    got = similar_texts.key_members(spark.createDataFrame(rows, "node bigint, keys array<bigint>, print bigint")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.key, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 7], [5, 6], [8, 9]]
    words = [f"w{k}" for k in range(120)]
    near = " ".join(words), " ".join([*words[:60], "other", *words[61:]])
    sketch = spark.createDataFrame(list(enumerate(near)), "k int, text string").select(similar_texts.sketched(F.col("text")).alias("s")).select("s.*").collect()
    assert [r.print for r in sketch] == [near_dedup.simhash(t) for t in near] and sketch[0].node != sketch[1].node


SPOKEN = {
    "en": "the of and to in is that for it was with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will more no if out so said what up its about into than them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many before must through years where much your way well down should because each just those people how too little state good very make world still see own work men day get here between both life being under never same another know while last might us great old year off come since against go came right used take three",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen was sagte gibt alle seit muss wurden beim doch jetzt waren drei jahre neue damit bereits da ihr seinen ohne sondern selbst ersten nun etwa heute weil ihm menschen deutschland anderen ihn sagt ganz leben ihren liegt gut recht zeit stadt einmal geht fragen welt arbeit frage",
    "fr": "le de un et il ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire me on mon lui nous comme mais pouvoir avec tout y aller voir bien sans tu ou leur homme si deux mari moi vouloir te femme venir quand grand celui notre devoir heure prendre trouver rien encore jour aussi quelque main vie tout sous savoir temps petit peu jamais autre apres toujours monde enfant chose parler donner oeil mettre fois pouvoir fille passer aimer tenir dieu porter moins fait demander rester comprendre pendant chez coeur terre personne maison depuis toute premier devenir connaitre laisser seul entre nuit sortir parce regarder attendre puis entendre vivre beau",
}


def test_language_stage_drops_what_has_no_profile(spark):
    rng = random.Random(9)
    said = lambda lang, n: " ".join(rng.choice(SPOKEN[lang].split()) for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 10))) for _ in range(n))
    rows = [(k, said(lang, rng.randint(50, 600)), lang) for k in range(160) for lang in [("en", "de")[k % 2]]]
    rows += [(200 + k, said(("en", "de")[k % 2], rng.randint(50, 600)), None) for k in range(20)]  # clean without a label
    rows += [(300 + k, said("fr", rng.randint(100, 600)), None) for k in range(20)]  # of a language without a profile
    rows += [(400 + k, noise(1000), None) for k in range(10)] + [(500, noise(3000), "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    left = {r.doc_id for r in passed_on(spark, corpus_pipeline.language_stage, docs).collect()}
    assert left == {r[0] for r in rows if r[0] < 300}
    named = docs.where("lang is not null")
    bounds = language_id.bounds(named, language_id.learn(named))
    assert set(bounds) == {"en", "de"} and all(b < corpus_pipeline.MAX_DISTANCE for b in bounds.values())
