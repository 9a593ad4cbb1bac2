"""BPE by forced boundaries against the unchanged library and against merging without cuts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortroll.llm import forced_bpe, queries

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = [*"abcXYZ 's't're  \n\t\r\x0b\x1c\x85\xa0 　​0123३\xe9\xdf漢\U0001f642́...!|>aathΣς;", "<|endoftext|>", "<|startoftext|>", "</w>", "İ"]


def made_up(n, seed, longest=80):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def digests(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    texts = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
    return (len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in texts))


@pytest.mark.parametrize("path, keeps_space", [(WORDS, False), (BYTES, True)])
def test_ids_and_texts_are_the_librarys(path, keeps_space):
    library, own = Tokenizer.from_file(path), forced_bpe.codec(path, keeps_space)
    for text in [*made_up(1500, seed=11), "", "zq" * 4000 + "a" * 60_000, "word " * 60_000, "é" * 999]:
        ids = own.parts.encode_batch([text])[0].tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_fragments_give_what_whole_words_give():
    model = forced_bpe.codec(WORDS, False).model
    rng = random.Random(2)
    words = [bytes(rng.choice(b"aehijlnoqrstxz0-\xc3\xa9") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    cuts = [int((~model.inside[s[:-1], s[1:]]).sum()) for s in map(model.symbols, words)]
    assert sum(cuts) > len(words)  # the words do fall into fragments
    assert model.encode(words) == [model.merge(model.ids[model.symbols(w)].tolist()) for w in words]
    many = [model.ids[model.symbols(w * 3)].tolist() for w in words[:500]]
    assert [model.merge_few(list(m)) for m in many] == [model.merge_many(list(m)) for m in many]
    assert model.encode([]) == [] and model.encode([b"", b"a", b""])[1:] == [model.ids[[97 + 256]].tolist(), []]


def test_forced_boundaries_of_a_small_vocabulary():
    letters = forced_bpe.byte_letters()
    vocab = {s: k for k, s in enumerate([*letters, *(c + "</w>" for c in letters), "ab", "abc</w>", "ca", "caab"])}
    merges = [("ab", "c</w>"), ("c", "a"), ("a", "b"), ("ca", "ab")]
    model = forced_bpe.ForcedBoundaries(vocab, [merges[2], merges[0], merges[1], merges[3]], "</w>")
    at = lambda a, b: bool(model.inside[ord(a), ord(b)])
    assert at("a", "b") and at("c", "a") and at("a", "a") and not at("b", "a") and not at("b", "c")
    assert model.inside[ord("b"), ord("c") + 256] and int(model.inside.sum()) == 4
    assert [[list(vocab)[i] for i in ids] for ids in model.encode([b"abc", b"caab", b"babab"])] == [
        ["abc</w>"], ["ca", "a", "b</w>"], ["b", "ab", "a", "b</w>"]]


def test_query_over_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    texts = [None, "", "same words", "same words", " \t\n", "x" * 260_000, "Long text, <|endoftext|> " * 30_000, *made_up(60, seed=3)]
    rows = [(k, t, "ids", 1) for k, t in enumerate(texts)] + [(None, "no id", None, None), (5, "again", "", 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(WORDS)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in queries.op12_forced_bpe(spark, str(tmp_path)).collect())
    assert got == sorted((-1 if k is None else k, *digests(library, t or "")) for k, t, _, _ in rows)
    assert forced_bpe.round_trip(frame.limit(0), WORDS).count() == 0
    back = {r.doc_id: r for r in forced_bpe.decode(forced_bpe.encode(frame.where("doc_id < 5"), WORDS), WORDS).collect()}
    assert back[2].decoded == "same</w> words</w>" and back[0].decoded == back[1].decoded == "" and back[0].ids == []
    nothing = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert forced_bpe.decode(nothing, WORDS).first().decoded == ""


def test_files_of_another_kind_are_refused(tmp_path):
    import json

    told = json.load(open(WORDS))
    told["model"]["byte_fallback"] = True
    (tmp_path / "other.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="byte_fallback"):
        forced_bpe.Codec(str(tmp_path / "other.json"), False)
    assert np.array_equal(np.sort([ord(c) for c in forced_bpe.byte_letters()]), np.unique([ord(c) for c in forced_bpe.byte_letters()]))
