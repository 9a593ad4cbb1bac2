"""Ids by the ``tokenizers`` library, from a bounded table of words for each worker.

White space bounds both vocabularies' words, and so does a full stop or comma after a Latin letter. A text's ids are
therefore those of its parts, and the library sees each distinct part of a worker's share once.
"""

from __future__ import annotations

import os
import re

import numpy as np

from cohortroll.llm.common import WHITE, WordTable, per_worker

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
STOPS = ",.;:!?"
# A plain word before a space or stop, stops before a space, a line end before a word, or whatever white space bounds.
SPACED = re.compile(rf" ?[{LATIN}]+(?=[ \n{STOPS}]|\Z)|[{STOPS}]+(?=[ \n]|\Z)|\n(?=[{LATIN}])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
UNSPACED = re.compile(rf"[{LATIN}]+(?=[ \n{STOPS}]|\Z)|[{STOPS}]+(?=[ \n]|\Z)|[^{WHITE}]+")
PLAIN = re.compile(rf"[{LATIN}]+")
AT_ONCE = 500  # plain words that the library gets as one text


def _encoder(tokenizer, keeps_space: bool, without_special=None):
    """Encodes distinct parts: plain words many to a text, told apart by the tokens that start or end a word; others singly.

    ``without_special`` is the same tokenizer, which doesn't look for special tokens' strings: for parts that hold none of them.
    """
    slow = tokenizer.encode_batch
    many = getattr(without_special or tokenizer, "encode_batch_fast", (without_special or tokenizer).encode_batch)
    strings = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if without_special else []
    held = re.compile("|".join(map(re.escape, strings))).search if strings else lambda part: None
    tokens = sorted(tokenizer.get_vocab().items(), key=lambda x: x[1])
    mark = np.array([t.startswith("Ġ") if keeps_space else t.endswith("</w>") for t, _ in tokens])

    def encode(parts: list[str]) -> list[list[int]]:
        plain = [k for k, w in enumerate(parts) if PLAIN.fullmatch(w, 1) and w[0] == " "] if keeps_space else [k for k, w in enumerate(parts) if PLAIN.fullmatch(w)]
        out: list[list[int] | None] = [None] * len(parts)
        groups = [plain[k:k + AT_ONCE] for k in range(0, len(plain), AT_ONCE)]
        texts = [("" if keeps_space else " ").join([parts[k] for k in group]) for group in groups]
        for group, e in zip(groups, many(texts, add_special_tokens=False)):
            at = np.flatnonzero(mark[e.ids])
            if len(at) == len(group):  # else some token holds more than one mark: singly
                ids, cuts = e.ids, [*at.tolist(), len(e.ids)] if keeps_space else [0, *(at + 1).tolist()]
                for k, a, b in zip(group, cuts, cuts[1:]):
                    out[k] = ids[a:b]
        rest = [k for k, ids in enumerate(out) if ids is None]
        special = [k for k in rest if held(parts[k])]
        for k, e in zip(special, slow([parts[k] for k in special], add_special_tokens=False)):
            out[k] = e.ids
        rest = [k for k in rest if out[k] is None]
        for k, e in zip(rest, many([parts[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    return encode


def library_words(path: str, keeps_space: bool) -> WordTable:
    """This worker's table for the tokenizer file at ``path``; special tokens' strings in a text become their ids, as the library has it.

    ``keeps_space``: white space belongs to the word that follows it (byte-level vocabularies); else it is dropped.
    """

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        tokenizer, fast = Tokenizer.from_file(path), Tokenizer.from_file(path)
        fast.encode_special_tokens = True  # it gets only parts without such strings, in which that changes nothing
        return WordTable((SPACED if keeps_space else UNSPACED).findall, _encoder(tokenizer, keeps_space, fast))

    return per_worker(("library", path, keeps_space), make)
