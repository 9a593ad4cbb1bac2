"""BPE by forced boundaries, and its inverse.

Two symbols that stand side by side inside no token of the vocabulary can never be merged, whatever surrounds them. Every
such pair in a word is therefore a certain cut: the fragments between cuts are encoded independently, each distinct one
once, and their ids are put together. What may stand side by side is read off the merges: a merge joins the last symbol of
its left token to the first symbol of its right one, and every inner pair of a token is the joint of some merge.

The symbols are the 256 bytes, and the 256 bytes that end a word where the vocabulary marks word ends. Normalisation and
the cut into words are those that the tokenizer file names; special tokens' strings in a text become their ids, as the
library has it. A worker keeps the ids of its parts of texts in a bounded table; nothing is shuffled or collected.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortroll.llm.common import WordTable, narrow, per_worker, ragged, text_slices, texts_of
from cohortroll.llm.library_tokens import PLAIN, SPACED, UNSPACED

ENDS = 256  # added to a byte that ends a word
FEW = 48  # symbols of a fragment that are merged by looking through them
NONE = 1 << 62  # stands for a pair that isn't merged


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class ForcedBoundaries:
    """Encodes words by a vocabulary's merges, cut wherever no token joins two symbols."""

    SHIFT = 20  # bits of an id

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        letters = byte_letters()
        symbols = [*letters, *(c + suffix for c in letters if suffix)]
        self.suffix = suffix
        self.ids = np.array([vocab.get(s, -1) for s in symbols])
        if (self.ids < 0).any():
            raise ValueError("a byte is no token of the vocabulary")
        first = {s: k for k, s in enumerate(symbols)}
        last = dict(first)
        self.inside = np.zeros((len(symbols), len(symbols)), bool)
        self.pairs: dict[int, int] = {}  # rank of the merge, then the id that it makes, in one number
        for rank, (a, b) in enumerate(merges):
            whole = a + b
            first[whole], last[whole] = first[a], last[b]
            self.inside[last[a], first[b]] = True
            self.pairs.setdefault(vocab[a] << self.SHIFT | vocab[b], rank << self.SHIFT | vocab[whole])

    def symbols(self, word: bytes) -> np.ndarray:
        out = np.frombuffer(word, np.uint8).astype(np.int64)
        if self.suffix and len(out):
            out[-1] += ENDS
        return out

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. All words are cut in one step; words never join, so a word's end is a cut as well."""
        parts = [self.symbols(w) for w in words]
        text = np.concatenate([np.zeros(0, np.int64), *parts])
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        cut = np.ones(len(text), bool)
        cut[:-1] = ~self.inside[text[:-1], text[1:]]
        cut[ends[ends > 0] - 1] = True
        stops = np.flatnonzero(cut) + 1
        flat, known, made = self.ids[text].tolist(), {}, []
        start = 0
        for stop in stops.tolist():
            if stop - start == 1:
                ids = flat[start:stop]
            else:
                key = tuple(flat[start:stop])
                ids = known.get(key)
                if ids is None:
                    ids = known[key] = self.merge(list(key))
            made.append(ids)
            start = stop
        last = np.searchsorted(stops, ends, "right")  # fragments up to the end of each word
        out, at = [], 0
        for to in last.tolist():
            out.append([i for ids in made[at:to] for i in ids] if to - at != 1 else made[at])
            at = to
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Ids of one fragment: the earliest merge first, the leftmost of its places first."""
        return self.merge_few(ids) if len(ids) <= FEW else self.merge_many(ids)

    def merge_few(self, ids: list[int]) -> list[int]:
        """For short fragments, whose pairs are looked through anew for each merge."""
        get, shift, new_id = self.pairs.get, self.SHIFT, (1 << self.SHIFT) - 1
        found = [get(a << shift | b, NONE) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == NONE:
                break
            k = found.index(best)
            new = ids[k] = best & new_id
            del ids[k + 1], found[k]
            if k < len(found):
                found[k] = get(new << shift | ids[k + 1], NONE)
            if k:
                found[k - 1] = get(ids[k - 1] << shift | new, NONE)
        return ids

    def merge_many(self, ids: list[int]) -> list[int]:
        """For long ones: the places of all pairs lie on a heap, and neighbours are linked."""
        get, shift, new_id = self.pairs.get, self.SHIFT, (1 << self.SHIFT) - 1
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        after[-1] = -1
        heap = [(found, p) for p, (a, b) in enumerate(zip(ids, ids[1:])) if (found := get(a << shift | b)) is not None]
        heapify(heap)
        while heap:
            best, p = heappop(heap)
            q = after[p]
            if ids[p] < 0 or q < 0 or get(ids[p] << shift | ids[q]) != best:
                continue  # one of the two was merged in the meantime
            new = best & new_id
            ids[p], ids[q] = new, -1
            right = after[p] = after[q]
            left = before[p]
            if right >= 0:
                before[right] = p
                found = get(new << shift | ids[right])
                if found is not None:
                    heappush(heap, (found, p))
            if left >= 0:
                found = get(ids[left] << shift | new)
                if found is not None:
                    heappush(heap, (found, left))
        return [i for i in ids if i >= 0]


class Codec:
    """A tokenizer file's way from text to ids and back; ``keeps_space`` as in ``library_tokens``."""

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, added = told["model"], told["added_tokens"]
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "dropout") if model.get(k)]
        if model["type"] != "BPE" or odd or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"not a plain byte-level BPE file: {odd}")
        library = Tokenizer.from_file(path)
        self.normalizer, self.words = library.normalizer, library.pre_tokenizer
        self.to_byte = {ord(c): b for b, c in enumerate(byte_letters())}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.model = ForcedBoundaries(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in added}
        strings = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, strings)) + ")").split if strings else lambda text: [text]
        kind = (told.get("decoder") or {"type": None})["type"]
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no way back by the decoder {kind}")
        tokens = {**model["vocab"], **self.added}
        size = max(tokens.values()) + 1
        self.joint, self.table = b" " if kind is None else b"", [b""] * size
        for token, k in tokens.items():
            plain = kind is None or any(ord(c) not in self.to_byte for c in token)
            self.table[k] = token.encode() if plain else bytes(self.to_byte[ord(c)] for c in token)
        self.numbers = [str(k) for k in range(size)]
        self.plain = self._plain_words_are_whole(keeps_space)
        self.parts = WordTable((SPACED if keeps_space else UNSPACED).findall, self.encode_parts)

    def _plain_words_are_whole(self, keeps_space: bool) -> bool:
        """Whether a word of Latin letters is one word in lower case by the file's own rules, as one of all of them shows."""
        probe = "".join(c for c in map(chr, range(256)) if PLAIN.match(c))
        return not keeps_space and self.cut_words(probe) == [probe.lower().encode()]

    def cut_words(self, text: str) -> list[bytes]:
        """The words of a text without special tokens, as bytes, by the file's normaliser and cutter."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        found = self.words.pre_tokenize_str(text) if self.words is not None else [(text, None)]
        return [bytes(map(self.to_byte.__getitem__, map(ord, w))) for w, _ in found]

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of distinct parts of texts; a part's words are encoded with those of all other parts."""
        words: list[bytes] = []
        plan: list[list[int | tuple[int, int]]] = []  # special ids, and ranges of words
        for part in parts:
            if self.plain and PLAIN.fullmatch(part):
                plan.append([(len(words), len(words) + 1)])
                words.append(part.lower().encode())
                continue
            steps: list[int | tuple[int, int]] = []
            for piece in self.split(part) if self.added else [part]:
                if piece in self.added:
                    steps.append(self.added[piece])
                elif piece:
                    found = self.cut_words(piece)
                    steps.append((len(words), len(words) + len(found)))
                    words += found
            plan.append(steps)
        ids = self.model.encode(words)
        out = []
        for steps in plan:
            if len(steps) == 1 and isinstance(steps[0], tuple) and steps[0][1] - steps[0][0] == 1:
                out.append(ids[steps[0][0]])
            else:
                out.append([i for s in steps for i in ([s] if isinstance(s, int) else (j for w in ids[s[0]:s[1]] for j in w))])
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text of some ids, special tokens included, in UTF-8: what is no valid UTF-8 becomes the replacement character."""
        data = self.joint.join(map(self.table.__getitem__, ids))
        return data if self.joint else data.decode("utf-8", "replace").encode()


def codec(path: str, keeps_space: bool) -> Codec:
    """This worker's codec."""
    return per_worker(("forced_bpe", path, keeps_space), lambda: Codec(path, keeps_space))


def encoded_batches(batches, path: str, keeps_space: bool):
    """``doc_id, ids`` of batches ``doc_id, text``."""
    table = codec(path, keeps_space).parts
    for batch in text_slices(batches):
        ids, ends = table.encode_batch(texts_of(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), ragged(ids, ends)], ["doc_id", "ids"])


def decoded_batches(batches, path: str, keeps_space: bool):
    """``doc_id, ids, decoded`` of batches ``doc_id, ids``."""
    back = codec(path, keeps_space).decode
    for batch in batches:
        texts = [back(x or []) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])


def digest_batches(batches, path: str, keeps_space: bool):
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of batches ``doc_id, ids``, whose ids are decoded here."""
    own = codec(path, keeps_space)
    number, back = own.numbers.__getitem__, own.decode
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for batch in batches:
        lists, ends = batch.column(1), batch.column(1).offsets.to_numpy().tolist()
        flat = lists.values.to_numpy(zero_copy_only=False)
        sizes, of_ids, of_texts = [], [], []
        for a, b in zip(ends, ends[1:]):
            ids = flat[a:b].tolist()
            sizes.append(b - a)
            of_ids.append(sha(" ".join(map(number, ids)).encode()))
            of_texts.append(sha(back(ids)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _kind(frame: DataFrame) -> str:
    return frame.schema["doc_id"].dataType.simpleString()


def encode(df: DataFrame, path: str, keeps_space: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: ids of each text by the BPE file at ``path``, without the ids that the file would add around it.

    One row per input row, repeated rows included; equal texts have equal ids. A null or empty text has no ids; a null id
    stays null. Texts of any length are whole. An empty table gives no rows. Other columns, whatever their names, aren't
    read. ``keeps_space``: the file's words hold the white space before them; else it drops white space.
    """
    frame = narrow(df, doc_id=doc_id, text=text)
    return frame.mapInArrow(lambda batches: encoded_batches(batches, path, keeps_space), f"doc_id {_kind(frame)}, ids array<int>")


def decode(df: DataFrame, path: str, keeps_space: bool = False, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, ids, decoded string``: each row's ids as text, special tokens included; a null or empty list gives the empty text.

    One row per input row; an empty table gives no rows; other columns aren't read. Ids outside the vocabulary are an error.
    """
    frame = narrow(df, doc_id=doc_id, ids=ids)
    schema = f"doc_id {_kind(frame)}, ids array<int>, decoded string"
    return frame.mapInArrow(lambda batches: decoded_batches(batches, path, keeps_space), schema)


def round_trip(df: DataFrame, path: str, keeps_space: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, decodes the ids and gives the digests of both, in one pass through Python; rows as in ``encode``."""
    frame = narrow(df, doc_id=doc_id, text=text)
    return frame.mapInArrow(
        lambda batches: digest_batches(encoded_batches(batches, path, keeps_space), path, keeps_space),
        f"doc_id {_kind(frame)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
