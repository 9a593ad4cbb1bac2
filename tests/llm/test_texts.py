"""Chat, licences, quality rules, language ID and the quality model against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortroll.llm import chat, language_id, licences, quality_model, quality_rules

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(seed, n, vocabulary=200):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, vocabulary)}" for _ in range(n)]


# --- chat ---

HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "[[INST]", "<<SYS>><</SYS>>", "[TURN]x[AS]y[/TURN]", "", "<s>\n<", "[/INST"]


@pytest.mark.parametrize("text", HOSTILE)
def test_escaping_is_reversible_and_leaves_no_mark(text):
    rules = chat.Formatter(chat.Template())
    for t in (text, text * 2, f"\\{text}\\"):
        assert rules.unescape(rules.escape(t)) == t and not rules.any_mark.search(rules.escape(t))


def test_conversations_read_back(spark):
    rows = [(c, k, role, text) for c, roles in enumerate([["user", "assistant"], ["system", "user", "assistant", "user"], ["assistant", "tool [AS]", "user"], ["user"] * 3])
            for k, (role, text) in enumerate(zip(roles, HOSTILE[c:] + HOSTILE))]
    rows += [(9, 0, None, None), (9, 0, "user", "tie"), (9, None, "system", "first"), (9, 0, "user", "tie"), (None, 1, "user", "no id"), (8, 1, "user", "x" * 300_000), (8, 2, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("state", df_lit("own"))
    formatted = chat.format_turns(df)
    problems = {(r.conv_id, r.place): r.problem for r in formatted.collect()}
    assert problems[0, 1] is None and problems[1, 3] == "open end" and problems[2, 0] == "unexpected assistant" and problems[3, 1] == "unexpected user"
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def df_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


# --- licences ---


@pytest.mark.parametrize("expression, labels", [
    ("MIT", {"mit"}), ("Apache-2.0 OR MIT", {"apache", "mit"}), ("(GPL-2.0+ WITH Classpath-exception-2.0) and BSD-3-Clause", {"gpl", "bsd"}),
    ("LGPL-2.1-only or ((MIT)) */ rest", {"lgpl", "mit"}), ("CC-BY-NC-4.0", {"cc-by-nc"}), ("Own-1", {"own-1"}), ("OR MIT", None), ("(MIT", None),
    ("MIT AND", None), ("", None), ("MIT) OR X", {"mit"})])
def test_licence_expressions(expression, labels):
    assert licences.evaluate(expression) == labels


def test_licence_places(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rng = random.Random(2)
    bits = ["GNU", "General", "Public", "license", "Apache", "MIT", "cc", "BY", "x\xe9", "and", "7"]
    texts = [None, "", "gnu general public license " * 3000, "SPDX-License-Identifier: MIT OR Apache-2.0\nmit-LICENSE", "cc by-nc 4.0", "cc K by",
             *(rng.choice([" ", "-", ".\n"]).join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("labels", df_lit("own"))
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in licences.scan(df).collect():
        w = word.findall((texts[r.doc_id] or "").translate(small))
        hits = [(k, label) for p, label in licences.BASE.items() for q in [p.split()] for k in range(len(w) - len(q) + 1) if w[k:k + len(q)] == q]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        if r.doc_id == 3:
            assert r.labels == "apache,mit"
        if r.doc_id == 4:
            assert r.labels == "cc-by,cc-by-nc"
    assert licences.scan(df.limit(0)).count() == 0


# --- quality rules ---


def measured_by_hand(text):
    w = SPACED.findall(text or "")
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if often[x] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_hosts(spark):
    rng = random.Random(5)
    texts = [None, "", " \x0b\x0c\r\t", "a b", "a a a a", "a b c a b c\na b c", "line\nline\n\n \nline", "\xa0 \x1c x", "one " * 5000, " lead\ntail ", "#*$ %&|<>"]
    texts += [rng.choice([" ", "\n", "  "]).join(words_of(k, rng.randint(1, 150), 12)) for k in range(80)]
    rows = [(k, t, f"h{k % 5}", "own") for k, t in enumerate(texts)]
    rows += [(1000 + k, " ".join(words_of(k, 80)), "good" if k % 3 else None, "own") for k in range(60)]
    rows += [(2000 + k, "short" if k < 55 else " ".join(words_of(k, 80)), "bad", "own") for k in range(60)] + [(2059, " ".join(words_of(59, 80)), "bad", "own")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, host string")
    out = quality_rules.judge(df).collect()
    assert len(out) == len(rows)
    text_of = {r[0]: r[1] for r in rows}
    host_of = {r[0]: r[2] for r in rows}
    for r in out:
        n, chars, symbols, lines, again = measured_by_hand(text_of[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, again), r.doc_id
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
        if host_of[r.doc_id] in ("bad", "good", None):
            assert r.host_failed == (host_of[r.doc_id] == "bad") and r.kept == (not r.base_failed and not r.host_failed)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_hosts_join_alike_by_either_way(spark):
    rows = spark.createDataFrame([(k, f"h{k % 4}" if k % 9 else None) for k in range(300)], "i int, host string")
    hosts = spark.createDataFrame([("h1", True), ("h3", True), ("h8", True)], "h string, bad boolean")
    for how in ("left", "left_anti"):
        few, many = (Counter(map(tuple, quality_rules.join_hosts(rows, "host", hosts, "h", how, few=n).collect())) for n in (10, 0))
        assert few == many and sum(few.values()) == (300 if how == "left" else sum(h not in ("h1", "h3") for _, h in rows.collect()))


def test_host_rates_are_shrunk(spark):
    rows = [("a", k < 5) for k in range(1000)] + [("b", k < 900) for k in range(1000)] + [("c", True)]
    df = spark.createDataFrame(rows, "host string, failed boolean")
    rates = {r.host: r.rate for r in quality_rules.host_verdicts(df, "host", "failed").collect()}
    assert 0.005 < rates["a"] < 0.02 and 0.88 < rates["b"] < 0.9 and 0.45 < rates["c"] < 1  # one row moves little
    same = spark.createDataFrame([(f"h{k % 4}", k % 2 == 0) for k in range(400)] + [("tiny", True)], "host string, failed boolean")
    assert all(abs(r.rate - 0.5) < 0.51 for r in quality_rules.host_verdicts(same, "host", "failed").collect())


# --- language ID ---

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "der"], "cc": ["\xe9e", "oui", "que", "eau"]}


def speech(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_gram_counts_of_slices_are_those_of_the_whole(monkeypatch):
    text = "Un caf\xe9,  漢字 12 " * 200 + "x"
    whole = language_id.gram_counts(text)
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(language_id, "SLICE", size)
        part = language_id.gram_counts(text)
        assert all((a == b).all() for a, b in zip(whole, part))


def test_languages(spark):
    rows = [(k, speech(lang, k), lang, "own") for k in range(120) for lang in [sorted(SYLLABLES)[k % 3]]]
    rows += [(500, None, "aa", "own"), (501, "", "aa", "own"), (502, "12 !! ́", None, "own"), (503, speech("bb", 7, 90_000), None, "own"), (503, speech("bb", 7), "bb", "own"), (None, speech("cc", 3), "aa", "own")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    out = language_id.predict(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        want = "cc" if r.doc_id is None else "und" if r.doc_id in (500, 501, 502) else "bb" if r.doc_id == 503 else sorted(SYLLABLES)[r.doc_id % 3]
        assert r.lang_pred == want
    assert language_id.predict(df.limit(0)).count() == 0
    nothing = language_id.predict(df.withColumn("lang", df_lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_profile_ties_and_out_of_place_distance(spark):
    df = spark.createDataFrame([("aa", "x"), ("ab", "x"), ("b", "y")], "text string, lang string")
    profiles = language_id.learn(df)
    assert profiles.names == ["x", "y"]
    lang, distance, following = profiles.blocks[0].identify("B")
    assert (lang, distance) == ("y", 0.0) and 0 < following < 1


def plain_rank_order(texts, profiles):
    """Nearest language by lists and dictionaries, for texts of letters and blanks."""
    def grams(text):
        held = {}
        marked = " " + " ".join(text.lower().split()) + " "
        for i, c in enumerate(marked):
            if c != " ":
                held[c] = held.get(c, 0) + 1
            if i and not (c == " " and marked[i - 1] == " "):
                held[marked[i - 1:i + 1]] = held.get(marked[i - 1:i + 1], 0) + 1
            if i > 1 and marked[i - 1] != " ":
                held[marked[i - 2:i + 1]] = held.get(marked[i - 2:i + 1], 0) + 1
        return held

    def number(g):  # ties go by code points, a word end before all letters
        value = 0
        for c in g:
            value = value << 21 | (1 if c == " " else ord(c))
        return value

    def order(counts):
        return sorted(counts, key=lambda g: (-counts[g], number(g)))[:language_id.PROFILE]

    learned = {}
    for lang, text in profiles:
        own = learned.setdefault(lang, {})
        for g, n in grams(text).items():
            own[g] = own.get(g, 0) + n
    places = {lang: {g: k for k, g in enumerate(order(counts))} for lang, counts in learned.items()}
    out = []
    for text in texts:
        own = order(grams(text))
        far = sorted((sum(abs(p[g] - k) if g in p else language_id.PROFILE for k, g in enumerate(own)) / (language_id.PROFILE * len(own)), lang)
                     for lang, p in places.items())
        out.append((far[0][1], far[0][0], 1 - far[0][0] / far[1][0] if far[1][0] > 0 else 0.0))
    return out


def test_rank_order_of_many_languages_in_blocks(spark, monkeypatch):
    rng = random.Random(12)
    names = [f"l{k:03d}" for k in range(600)]  # more than one block holds
    letters = {name: "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 7)) for name in names}

    def speak(name):
        return " ".join("".join(rng.choice(letters[name]) for _ in range(rng.randint(2, 6))) for _ in range(25))

    learned = [(name, speak(name)) for name in names for _ in range(2)]
    asked = [speak(name) for name in rng.sample(names, 60)] + [learned[0][1]] * 2
    df = spark.createDataFrame(learned, "lang string, text string")
    model = language_id.learn(df)
    assert model.names == names and [len(b.names) for b in model.blocks] == [500, 100]
    want = plain_rank_order(asked, learned)
    monkeypatch.setattr(language_id, "BLOCK", 70)
    for own in (model, language_id.learn(df)):
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "k int, text string")
        got = rows.select("k", language_id.identified(F.col("text"), own).alias("r")).select("k", "r.*").orderBy("k").collect()
        for r, (lang, distance, score) in zip(got, want):
            assert r.lang_pred == lang and abs(r.distance - distance) < 1e-12 and abs(r.score - score) < 1e-9


# --- quality model ---


def test_quality_model_on_held_out_rows(spark):
    rng = random.Random(1)

    def text(k, good):
        return " ".join(words_of(k, rng.randint(20, 80), 900)) if good else "!! ".join(w.upper() for w in words_of(k, rng.randint(20, 80), 9))

    rows = [(k, text(k, k % 3 > 0), "own") for k in range(900)] + [(5000, None, "own"), (5001, "", "own"), (5002, "y" * 4_500_000, "own"), (None, "no id", "own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), "own") for k in range(900)] + [(3, 1, "own"), (3, None, "own"), (None, 1, "own"), (77777, 1, "own")], "doc_id bigint, quality int, x string")
    out = quality_model.predict(docs, labels).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert len(held) > 150 and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    none = quality_model.predict(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_model.predict(docs.limit(0), labels).count() == 0


def test_flat_trees_follow_their_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    assert ((quality_model.fit(x, y).score(x) > 0.5) == y).mean() > 0.97
    assert (quality_model.fit(x, np.ones(2000)).score(x) > 0.99).all()


def plain_statistics(text):
    """Every statistic of a whole text by sets and lists."""
    data = text.encode()
    words, size = data.split(), max(len(data), 1)
    n, lines = max(len(words), 1), [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    count = lambda chars: sum(data.count(c) for c in chars) / size
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    marks = {c for c in range(33, 127) if not chr(c).isalnum()}
    share = [data.count(c) / size for c in set(data)]
    return dict(zip(quality_model.STATISTICS, (
        math.log1p(len(data)), math.log1p(len(words)), mean, math.sqrt(sum((k - mean) ** 2 for k in sizes) / n), len(set(words)) / n,
        len(set(windows)) / len(windows) if windows else 1.0, max((words.count(w) for w in set(words)), default=0) / n,
        count(range(65, 91)), count(range(48, 58)), count(b" \t"), count(b"\n"), count(range(128, 256)), count(b".!?"), count(b",;:"),
        sum(a == b and b in marks for a, b in zip(data, data[1:])) / size, count(b"|"), count(b"#"), count(b"$%&*+<=>@[]^_`{}~/\\"),
        len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1), sum(k > 15 for k in sizes) / n,
        sum(k < 3 for k in sizes) / n if words else 1.0, -sum(p * math.log2(p) for p in share), sum(65 <= w[0] <= 90 for w in words) / n)))


@pytest.mark.parametrize("size", [7, 100, 2_000_000])
def test_statistics_are_those_of_the_whole_text_at_every_slice(size, monkeypatch):
    monkeypatch.setattr(quality_model, "SLICE", size)
    rng = random.Random(4)
    texts = ["", " \n\t ", "One", "a b", "same line\n" * 40, "no-space-" * 50, "Ein Stück, ein Stück!! ##|| Ümläut\n\n \nEnde..."]
    texts += ["".join(rng.choice("aB c\n.!!#é9 |") for _ in range(rng.randint(1, 700))) for _ in range(60)]
    for text in texts:
        got = dict(zip(quality_model.STATISTICS, quality_model.statistics(text)))
        want = plain_statistics(text)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want), (text, {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) >= 1e-9})


def test_statistics_of_a_long_text_of_known_shares():
    passage = " ".join(f"w{k}" for k in range(400_000))
    got = dict(zip(quality_model.STATISTICS, quality_model.statistics(passage + "\n" + passage)))
    assert len(passage) > 2_500_000 and got["distinct_words"] == 0.5 and got["distinct_lines"] == 0.5
    assert abs(got["distinct_windows"] - 400_000 / 799_998) < 1e-12 and got["top_word"] == 2 / 800_000


def test_tree_walk_is_the_plain_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, len(quality_model.STATISTICS))).astype(np.float32)
    trees = quality_model.fit(x, ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float))

    def walk(row):
        total = trees.base
        for node in trees.roots.tolist():
            while trees.left[node] != node:
                node = int(trees.right[node] if row[trees.feature[node]] > trees.threshold[node] else trees.left[node])
            total += trees.value[node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(trees.score(x[:200]), [walk(r) for r in x[:200]], atol=1e-12)
