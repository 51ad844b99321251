"""Chunk cache in front of a byte-level tokenizer of the ``tokenizers`` library.

The vocabulary's pattern starts a new piece at every single space between two
characters that are not white space.  So a text falls apart at its single
spaces into chunks that can be coded on their own, and a chunk is coded once
per worker, piece by piece.  A text in which a space meets other white space,
or that holds a special token, goes to the library whole; so does a chunk with
characters outside Latin script and punctuation.
"""

from __future__ import annotations

import os
import re
from operator import itemgetter

import numpy as np

from .tokenize import _ALPHABET, _OTHER, Remembered, id_bytes

#: The pattern of the vocabulary's pre-tokenizer (a fixed value of its format).
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A space beside white space, or at the end after white space.
_RUN = re.compile(r"\s (?:\s|\Z)")
LONGEST = 64               # code points of a chunk that is remembered
GROUP = 64                 # texts coded together by the library
_WORKERS: dict = {}


class ChunkCacheTokenizer:
    """Ids as little-endian bytes per text (``dtype``); equal to the library's ids."""

    def __init__(self, path: str, max_chunks: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.code, self.kind = self.tokenizer.model.tokenize, "H" if self.dtype == "<u2" else "I"
        #: A chunk stands for itself after one space; with a space before it, for itself without one.
        self.chunks = Remembered(self._learn, max_chunks, LONGEST)

    @classmethod
    def of_worker(cls, path: str) -> "ChunkCacheTokenizer":
        if path not in _WORKERS:
            _WORKERS[path] = cls(path)
        return _WORKERS[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():          # one piece of letters that stand for themselves
            return id_bytes(self.code("Ġ" + chunk), self.kind)
        text = chunk[1:] if chunk[:1] == " " else " " + chunk
        if _OTHER.search(text):
            return self._library([text])[0]
        pieces = _PIECE.findall(text)
        if len(pieces) != 1:
            return b"".join([self.chunks[p[1:] if p[0] == " " else " " + p] for p in pieces])
        return id_bytes(self.code(text.encode().decode("latin-1").translate(_ALPHABET)), self.kind)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        whole, known = [], self.chunks
        for i, text in enumerate(texts):
            if _RUN.search(text) or (self.special and self.special.search(text)):
                whole.append(i)
                continue
            chunks = text.split(" ")
            chunks[0] = " " + chunks[0]              # no space precedes it
            out[i] = b"".join(itemgetter(*chunks)(known)) if len(chunks) > 1 else known[chunks[0]]
            known.turn()
        for i in range(0, len(whole), GROUP):
            part = whole[i:i + GROUP]
            for j, ids in zip(part, self._library([texts[k] for k in part])):
                out[j] = ids
        return out
