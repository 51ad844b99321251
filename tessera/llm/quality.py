"""Operator 3: quality rules as a short-circuit cascade.

Each rule rejects a text on one feature; features are worked out on demand.
``estimate`` times every rule and counts its rejections on a bounded sample of
rows inside one executor task, and ``order_rules`` puts the rules with the
most rejections per second first, so most bad texts meet one or two rules.
A text is kept if no rule rejects it, so the verdict does not depend on the
order; only the time does.

Words are runs of other characters than space and \\t to \\r.  Null and empty
texts have no words and are rejected for it.  Repeated rows get equal results;
only the id and text columns enter, so other columns cannot clash; an empty
table gives no rows.
"""

from __future__ import annotations

import time
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_bytes, mix64, word_hashes

SAMPLE_ROWS = 400
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 5


class Text:
    """Features of one text (UTF-8 bytes), each worked out at first use."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self):
        return self.raw.split()

    @property
    def n_words(self):
        return len(self.words)

    @cached_property
    def word_chars(self):
        return len(self.raw.translate(None, _CONTINUATION + SPACES))

    @cached_property
    def n_symbols(self):
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self):
        """Lines with a word, and how many of them equal an earlier line."""
        lines = [x for x in self.raw.split(b"\n") if x.strip(SPACES)]
        return len(lines), len(lines) - len(set(lines))

    @cached_property
    def word_ids(self):
        place: dict = {}
        ids = np.fromiter((place.setdefault(w, len(place)) for w in self.words), np.int64, self.n_words)
        return ids, list(place)

    @cached_property
    def n_repeat_words(self):
        """Words inside five-word windows that occur twice or more."""
        n = self.n_words
        if n < WINDOW + 1:
            return 0
        ids, vocab = self.word_ids
        if len(vocab) == n:
            return 0
        if len(vocab) < 4096:                 # five ids fit 60 bits: exact
            key = np.zeros(n - WINDOW + 1, np.int64)
            for k in range(WINDOW):
                key = (key << 12) | ids[k:n - WINDOW + 1 + k]
        else:                                 # 64-bit hashes of the windows
            h, key = mix64(word_hashes(vocab))[ids], np.zeros(n - WINDOW + 1, np.uint64)
            for k in range(WINDOW):
                key = mix64(key + h[k:n - WINDOW + 1 + k])
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[inverse] > 1)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        return int((np.cumsum(cover)[:n] > 0).sum())

    @cached_property
    def n_stutter(self):
        """Words equal to the word before them."""
        w = self.words
        return sum(map(bytes.__eq__, w[1:], w))

    @cached_property
    def n_shouted(self):
        """Words of two or more letters, all of them capitals."""
        if self.raw.isascii() and self.raw.islower():
            return 0
        return sum(not 97 <= w[0] <= 122 and (s := w.decode()).isupper() and sum(map(str.isalpha, s)) > 1 for w in self.words)

    @cached_property
    def n_exclaims(self):
        return self.raw.count(b"!")


#: name -> (base rule or not, test).  Shares are in percent of the words.
RULES = {
    "few_words": (True, lambda t: t.n_words < 10),
    "repeated_windows": (True, lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    "symbols": (False, lambda t: 100 * t.n_symbols > 10 * t.n_words),
    "exclamations": (False, lambda t: 100 * t.n_exclaims > 30 * t.n_words),
    "word_length": (False, lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    "stutter": (False, lambda t: 100 * t.n_stutter > 20 * t.n_words),
    "shouting": (False, lambda t: 100 * t.n_shouted > 30 * t.n_words),
    "repeated_lines": (False, lambda t: 100 * t.lines[1] > 50 * t.lines[0]),
}


def estimate(docs: DataFrame, text_col: str = "text", rules: dict = RULES, sample_rows: int = SAMPLE_ROWS,
             seed: int = 7) -> dict:
    """rule -> (seconds a text, share rejected) on a sample of ``sample_rows``
    rows at most, measured in one executor task; texts do not reach the driver."""
    total = docs.count()
    if not total:
        return {r: (1.0, 0.0) for r in rules}
    part = docs.select(F.col(text_col).cast("string").alias("text"))
    part = part.sample(min(1.0, 2.0 * sample_rows / total), seed).limit(sample_rows).coalesce(1)
    names = list(rules)

    def measure(batches):
        spent, hits, n = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0), 0
        for b in batches:
            for raw in as_bytes(b.column(0)):
                n += 1
                for r in names:
                    t = Text(raw)               # anew, so that each rule pays for its own features
                    began = time.perf_counter()
                    hits[r] += bool(rules[r][1](t))
                    spent[r] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([spent[r] / max(1, n) for r in names]),
                                          pa.array([hits[r] / max(1, n) for r in names])], ["rule", "cost", "share"])
    rows = part.mapInArrow(measure, "rule string, cost double, share double").collect()
    return {r["rule"]: (r["cost"], r["share"]) for r in rows} or {r: (1.0, 0.0) for r in rules}


def order_rules(estimates: dict) -> list[str]:
    """Most rejections per second first; ties by name."""
    return sorted(estimates, key=lambda r: (-estimates[r][1] / max(estimates[r][0], 1e-9), r))


def _first_failure(t: Text, order, rules):
    return next((r for r in order if rules[r][1](t)), None)


def cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES,
            order: list[str] | None = None, stats: bool = False) -> DataFrame:
    """doc_id, kept and rejected_by (the first rule of the order that rejects);
    with ``stats`` also the counts of the base rules for every row."""
    order = order or order_rules(estimate(docs, text_col, rules))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = f"doc_id {id_type}, kept boolean, rejected_by string"
    if stats:
        schema += "".join(f", {c} long" for c in counts) + ", base_failed boolean"

    def judge(batches):
        for b in batches:
            kept, by, more = [], [], []
            for raw in as_bytes(b.column(1)):
                t = Text(raw)
                by.append(_first_failure(t, order, rules))
                kept.append(by[-1] is None)
                if stats:
                    more.append((t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words,
                                 any(rules[r][0] and rules[r][1](t) for r in order)))
            cols, names = [b.column(0), pa.array(kept, pa.bool_()), pa.array(by, pa.string())], ["doc_id", "kept", "rejected_by"]
            if stats:
                kinds = [pa.int64()] * 5 + [pa.bool_()]
                cols += [pa.array([m[i] for m in more], k) for i, k in enumerate(kinds)]
                names += [*counts, "base_failed"]
            yield pa.RecordBatch.from_arrays(cols, names)
    return rows.mapInArrow(judge, schema)


def keep_good(docs: DataFrame, text_col: str = "text", rules: dict = RULES, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects."""
    order = order or order_rules(estimate(docs, text_col, rules))
    at = docs.columns.index(text_col)

    def judge(batches):
        for b in batches:
            yield b.filter(pa.array([_first_failure(Text(x), order, rules) is None for x in as_bytes(b.column(at))], pa.bool_()))
    return docs.mapInArrow(judge, docs.schema)
