"""Encoding, packing and token files against the libraries that they must agree with."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from cohortroll.llm import byte_bpe, packing, queries, token_files
from cohortroll.llm.library_tokens import library_words
from cohortroll.session import scratch_path

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"abcXYZ 's't're  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　​0123३\xe9\xdf漢\U0001f642́...!!|>aaaththΣς", "<|endoftext|>", "<|startoftext|>", "</s>", "</w>", "İ"]


def made_up(n, seed=1, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def whole_text_library(path):
    return Tokenizer.from_file(path)  # as the library has it: no setting is changed


def documents(spark, texts):
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)


def test_merge_replay_agrees_with_tiktoken(reference):
    words, table = byte_bpe.codec(RANKS, PATTERN)
    texts = [*made_up(1500), "a" * 3000 + " " * 300 + "ab" * 5000, "thth" * 40, " foo bar" * 30_000]
    for text in texts:
        ids, ends = words.encode_batch([text])
        assert ids.tolist() == reference.encode_ordinary(text)
        assert b"".join(table[i] for i in ids) == text.encode()
        assert ends.tolist() == [0, len(ids)]


def test_replay_lets_a_lower_new_rank_go_first():
    # After "bc" the pair (a, bc) makes a token of lower rank than "bc" itself.
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"abc": 1, b"bc": 5, b"cb": 4, b"bcb": 2}
    replay = byte_bpe.MergeReplay(ranks)
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    assert replay.encode([w.encode() for w in words]) == [own.encode_ordinary(w) for w in words]


def test_word_table_is_cut_down_when_full(reference, monkeypatch):
    monkeypatch.setattr("cohortroll.llm.common.KNOWN_WORDS", 20)
    words, _ = byte_bpe.codec(RANKS, PATTERN)
    for text in made_up(80, seed=4):
        assert words.encode_batch([text, text])[0].tolist() == 2 * reference.encode_ordinary(text)


def test_encode_and_decode_rows(spark, reference):
    texts = [None, "", "same", "same", "x" * 250_000, " ".join(made_up(200)), *made_up(20)]
    df = documents(spark, texts).union(spark.createDataFrame([(None, "no id", "x")], "doc_id bigint, text string, ids string"))
    out = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).collect()}
    assert len(out) == len(texts) + 1
    for k, text in enumerate(texts):
        assert list(out[k].ids) == reference.encode_ordinary(text or "") and bytes(out[k].decoded).decode() == (text or "")
    assert bytes(out[None].decoded) == b"no id"
    for r in byte_bpe.round_trip(df, RANKS, PATTERN).collect():
        assert r.n_tokens == len(out[r.doc_id].ids) and r.decoded_sha256 == hashlib.sha256(bytes(out[r.doc_id].decoded)).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, out[r.doc_id].ids)).encode()).hexdigest()
    assert byte_bpe.round_trip(df.limit(0), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("path, keeps_space", [(BYTES, True), (WORDS, False)])
def test_words_by_the_library(path, keeps_space):
    whole, words = whole_text_library(path), library_words(path, keeps_space)
    for text in [*made_up(1200, seed=2), "Un caf\xe9, s'il vous pla\xeet.\nIt's 12 o'clock!  Yes..."]:
        assert words.encode_batch([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path, keeps_space", [(BYTES, True), (WORDS, False)])
def test_special_tokens_strings_are_as_the_library_has_them(path, keeps_space, monkeypatch):
    monkeypatch.setattr("cohortroll.llm.common.LIST_LIMIT", 40)  # so that strings stand across the ends of slices
    whole, words = whole_text_library(path), library_words(path, keeps_space)
    for mark in ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"):
        for text in (mark, mark * 2, f"a{mark}b", f" {mark} ", f"one,  {mark}\n\n{mark}x, y", mark[:-1], *(f"{'w ' * k}{mark}. Two {mark}" * 4 for k in range(12, 24))):
            assert words.encode_batch([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def best_fit(histogram, capacity):
    rooms, n = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is None:
                n, fit = n + 1, capacity
            else:
                rooms.remove(fit)
            rooms.append(fit - length)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_has_no_gap_and_few_sequences(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 512, 4096])
    histogram = Counter(min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.randint(1, 1500)))
    plan = packing.Plan(histogram, capacity)
    lengths = np.repeat(list(histogram), list(histogram.values()))
    numbers = np.concatenate([np.arange(c) for c in histogram.values()])
    sequence, offset = plan.place(lengths, numbers)
    held = {}
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist())):
        assert held.get(s, 0) == o
        held[s] = o + n
    assert max(held.values()) <= capacity and sorted(held) == list(range(plan.n_sequences))
    assert plan.n_sequences <= best_fit(histogram, capacity) * 1.03 + 1


def test_plan_of_nothing_and_of_bad_lengths():
    assert packing.Plan({}, 10).n_sequences == 0
    with pytest.raises(ValueError):
        packing.Plan({11: 1}, 10)


def test_non_negative_fit():
    a, x = np.array([[1.0, 0, 1], [0, 1, 1]]), packing.non_negative_fit(np.array([[1.0, 0, 1], [0, 1, 1]]), np.array([3.0, -1]))
    assert (x >= 0).all() and np.allclose(a @ x, [3, 0])


def test_pieces_and_packs_of_documents(spark):
    whole = whole_text_library(WORDS)
    texts = [None, "", "one two", "one two", "word " * 9000, *made_up(60, seed=5, longest=3000)]
    pieces = packing.token_pieces(documents(spark, texts), WORDS, 1, capacity=1000)
    rows = packing.pack(pieces.withColumnRenamed("start", "_task"), 1000).withColumnRenamed("_task", "start").collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, text in enumerate(texts):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == ids and all(r.length == 1000 for r in own[:-1])
        assert all(r.start == 1000 * r.piece and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    for held in by_sequence.values():
        end = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1000
    assert packing.pack(pieces.limit(0), 1000).count() == 0
    at_once = packing.pack_documents(documents(spark, texts), WORDS, 1, capacity=1000, with_ids=False).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in at_once) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_token_files(spark):
    whole = whole_text_library(BYTES)
    texts = [None, "", "same", "same", "long " * 60_000, *made_up(50, seed=6)]
    ordered = token_files.in_id_order(documents(spark, texts).union(documents(spark, ["again"])))
    folder = scratch_path(spark, "files")
    manifest = token_files.with_bases(token_files.write_files(token_files.encode_documents(ordered, BYTES, 2), folder))
    rows = sorted(token_files.read_files(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([0, *range(len(texts))])
    want = sorted(([*whole.encode(t or "", add_special_tokens=False).ids, 2], k) for k, t in [*enumerate(texts), (0, "again")])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i, k in want)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    empty = token_files.write_files(token_files.encode_documents(ordered.limit(0), BYTES, 2), folder)
    assert token_files.read_files(token_files.with_bases(empty), folder).count() == 0


def test_token_files_refuse_what_does_not_fit(spark):
    wide = spark.createDataFrame([(1, [70_000])], "doc_id bigint, ids array<int>")
    with pytest.raises(Exception, match="don't fit"):
        token_files.write_files(wide, scratch_path(spark, "files"))
    nameless = spark.createDataFrame([(None, [7])], "doc_id bigint, ids array<int>")
    with pytest.raises(Exception, match="without an id"):
        token_files.write_files(nameless, scratch_path(spark, "files"))


def test_token_files_of_null_ids(spark, tmp_path):
    texts = {None: ["of no id", None, "", "of no id"], -3: ["below zero"], 0: ["zero", "again"], 2**62 + 1: ["beyond a double"]}
    rows = [(k, t) for k, many in texts.items() for t in many]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op10_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 4 + [-3, 0, 0, 2**62 + 1]
    whole = whole_text_library(BYTES)
    want = [(k, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in want)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
