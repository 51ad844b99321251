"""Word-level cache in front of a tokenizer of the ``tokenizers`` library.

The vocabulary cuts a normalised text into pieces with a fixed pattern and
codes each piece on its own; no piece spans white space.  So a word needs to
be coded once per worker, and a new word only for its new pieces.  A text with
characters whose normalisation depends on tables or context (outside
Latin script and general punctuation), or that may hold a special token, goes
to the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from operator import itemgetter

import numpy as np

#: Characters for which the cut below equals the library's: Latin letters,
#: ASCII, general punctuation; without superscript digits and fractions.
_OTHER = re.compile("[^\x00-\x1b\x20-ɏ‐-‧‰-⁞€]|[\xb2\xb3\xb9\xbc-\xbe]|<\\|")
#: The pattern of the vocabulary's pre-tokenizer (a fixed value of its format).
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Byte-level alphabet: printable Latin-1 characters stand for themselves, the
#: other bytes for the code points from 256 on, in order (a fixed value).
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}
_WORKERS: dict = {}
GROUP = 64                 # texts coded together by the library


class Remembered(dict):
    """Ids by key, learned when first asked for.  When full, the entries become
    the older ones, from which those in use come back, so common keys stay."""

    def __init__(self, learn, most: int, longest: int = 64):
        self.learn, self.half, self.longest, self.older = learn, most // 2, longest, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.learn(key)
        if len(key) <= self.longest:
            self[key] = ids
        return ids

    def turn(self):
        if len(self) > self.half:
            self.older = dict(self)
            self.clear()


def id_bytes(tokens, kind: str = "H") -> bytes:
    """Ids of a model's tokens as little-endian bytes."""
    ids = array(kind, [t.id for t in tokens])
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def odd(text: str) -> bool:
    """Whether the text holds what ``_OTHER`` finds; in ASCII that is little to look for."""
    if text.isascii():
        return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _OTHER.search(text) is not None


class WordCacheTokenizer:
    """Ids as little-endian uint16 bytes per text; equal to the library's ids."""

    def __init__(self, path: str, max_words: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)      # a special token's string in a text is that token, as the library has it
        self.code = self.tokenizer.model.tokenize
        self.words = Remembered(self._learn, max_words)

    @classmethod
    def of_worker(cls, path: str) -> "WordCacheTokenizer":
        if path not in _WORKERS:
            _WORKERS[path] = cls(path)
        return _WORKERS[path]

    def _library(self, texts):
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.asarray(e.ids, dtype="<u2").tobytes()

    def _learn(self, word: str) -> bytes:
        # the word is normal already: only the byte alphabet and the merges are left
        if word.isascii() and word.isalpha():
            return id_bytes(self.code(word))
        pieces = _PIECE.findall(word)
        if len(pieces) != 1 or pieces[0] != word:
            return b"".join([self.words[p] for p in pieces])
        plain = word.isascii() and word.isprintable()       # then its letters stand for themselves
        return id_bytes(self.code(word if plain else word.encode().decode("latin-1").translate(_ALPHABET)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        whole, known = [], self.words
        for i, text in enumerate(texts):
            if odd(text):
                whole.append(i)
                continue
            words = text.lower().split()
            out[i] = b"".join(itemgetter(*words)(known)) if len(words) > 1 else b"".join(map(known.__getitem__, words))
            known.turn()
        for i in range(0, len(whole), GROUP):
            part = whole[i:i + GROUP]
            for j, ids in zip(part, self._library([texts[k] for k in part])):
                out[j] = ids
        return out
