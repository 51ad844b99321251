"""Operator 8: toxicity by a weighted finite-state pattern grammar.

A text is a stream of clauses, a clause a stream of word classes.  Five small
machines read the classes: insult runs, threats, targets ("you ..."), negation
("not ...") and reported speech ("he said ...").  ``compose`` builds their
product once: a table from (state, class) to (next state, factor).  An insult
or threat adds its lexicon weight times the factor of the state it is met in,
so an insult at a person counts more, a negated or a quoted one less.  What is
scored are the clauses: the largest and the summed clause score and how many
clauses match, turned into a probability by a logistic fit.

The lexicon has a built-in part and, from the labelled rows, words and word
stems that toxic texts use far more often than others.  It is learned from at
most ``MAX_LABELLED`` rows, taken by hash, of those ids the caller allows.

Defined cases: null and empty texts match no clause and get the score of a
text without matches; repeated rows get equal scores; null labels are not
learned from; without labels of both kinds the built-in weights are used; an
empty table gives no rows.  Only id and text enter a score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

MAX_LABELLED = 20_000      # labelled rows learned from, at most
MIN_TEXTS = 5              # labelled toxic texts that must hold a learned entry
MIN_LOG_ODDS = math.log(8)
STEMS = range(5, 9)        # lengths of word starts that may be learned
MAX_WORDS_CACHED = 400_000

OTHER, BREAK, TARGET, NEGATION, REPORT, THREAT, INSULT = range(7)
#: Built-in lexicon (fixed values).
BUILT_IN = {
    INSULT: "idiot moron stupid loser scum trash pathetic worthless disgusting clown fool imbecile vermin filth coward "
            "dumb retard freak bastard bitch asshole idiota imbécil estúpido basura dummkopf idiotisch abschaum crétin ordure",
    THREAT: "kill hurt destroy beat stab shoot punish murder matar töten tuer",
    TARGET: "you your you're yours u he she they them him her his their tu te ustedes du dich ihr sie vous toi",
    NEGATION: "not no never don't isn't aren't wasn't nobody nicht kein keine nie ne pas jamais nunca",
    REPORT: "said says called claimed wrote quoted reported according dijo sagte schrieb dit déclaré",
}
BUILT_IN_WEIGHT = {INSULT: 3.0, THREAT: 1.0}


# ---- the machines: each maps (state, class) to (state, note) ----------------

def _countdown(symbol, width):
    """In a positive state for ``width`` words after ``symbol``; a break ends it."""
    def step(state, c):
        if c == symbol:
            return width
        return 0 if c == BREAK else max(0, state - 1)
    return step


def _until_break(symbol):
    def step(state, c):
        return 1 if c == symbol else 0 if c == BREAK else state
    return step


def _run(symbol, most):
    def step(state, c):
        return min(most, state + 1) if c == symbol else 0
    return step


MACHINES = {"insult": _run(INSULT, 3), "threat": _countdown(THREAT, 4), "target": _countdown(TARGET, 4),
            "negation": _countdown(NEGATION, 3), "reported": _until_break(REPORT)}


def _factor(before: dict, c: int) -> float:
    """Weight of an insult or threat met in the product state ``before``."""
    if c not in (INSULT, THREAT):
        return 0.0
    f = 1.0
    if before["target"]:
        f *= 1.3
    if before["negation"]:
        f *= 0.4
    if before["reported"]:
        f *= 0.5
    if c == INSULT and before["insult"]:
        f *= 1.2                       # insults in a row
    if c == INSULT and before["threat"]:
        f *= 1.3
    if c == THREAT and not before["target"]:
        f *= 0.1                       # a threat needs someone it is aimed at
    return f


def compose() -> tuple[list[list[int]], list[list[float]]]:
    """The product of the machines: next state and factor by (state, class)."""
    names = list(MACHINES)
    start = (0,) * len(names)
    number, todo, step, factor = {start: 0}, [start], [], []
    while len(step) < len(todo):
        state = todo[len(step)]
        nexts, factors = [], []
        for c in range(7):
            after = tuple(MACHINES[n](s, c) for n, s in zip(names, state))
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            nexts.append(number[after])
            factors.append(_factor(dict(zip(names, state)), c))
        step.append(nexts)
        factor.append(factors)
    return step, factor


def plain(word: bytes) -> str:
    """A word in lower case without signs at its ends."""
    w = word.decode("utf-8", "replace").casefold()
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b].replace("’", "'")


class Grammar:
    """Lexicon and composed machines; ``features`` scores one text."""

    def __init__(self, learned: dict[str, float]):
        self.words = {w: (c, BUILT_IN_WEIGHT.get(c, 0.0)) for c, ws in BUILT_IN.items() for w in ws.split()}
        for entry, weight in learned.items():
            if not entry.endswith("*") and self.words.get(entry, (INSULT,))[0] in (INSULT, THREAT):
                self.words[entry] = (INSULT, weight)
        self.stems = {e[:-1]: w for e, w in learned.items() if e.endswith("*")}
        self.step, self.factor = compose()
        self.cache: dict[bytes, tuple] = {}

    def look_up(self, raw: bytes) -> tuple:
        """(class, weight, ends a clause) of a raw word."""
        w = plain(raw)
        c, weight = self.words.get(w, (OTHER, 0.0))
        if c == OTHER and self.stems:
            best = max((self.stems.get(w[:n], 0.0) for n in STEMS if n < len(w)), default=0.0)
            if best:
                c, weight = INSULT, best
        return c, weight, raw[-1:] in b".!?;:" and len(raw) > 0

    def features(self, raw: bytes) -> tuple[float, float, float, float]:
        """Largest clause, log of the sum, matched clauses, matches a word."""
        words = raw.split()
        if len(self.cache) > MAX_WORDS_CACHED:
            self.cache.clear()
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = self.look_up(w)
        seen = [cache[w] for w in words]
        if not any(x[1] for x in seen):
            return 0.0, 0.0, 0.0, 0.0
        state, clause, top, total, clauses, hits = 0, 0.0, 0.0, 0.0, 0, 0
        for c, weight, ends in seen:
            if weight:
                add = weight * self.factor[state][c]
                clause += add
                hits += add > 0
            state = self.step[state][c]
            if ends:
                state = self.step[state][BREAK]
                total, top, clauses = total + clause, max(top, clause), clauses + (clause > 0)
                clause = 0.0
        total, top, clauses = total + clause, max(top, clause), clauses + (clause > 0)
        return top, math.log1p(total), math.sqrt(clauses), min(1.0, 10.0 * hits / len(words))


# ---- learning ---------------------------------------------------------------

def _entries(raw: bytes) -> set[str]:
    out = set()
    for w in {plain(x) for x in set(raw.split())}:
        if w.replace("'", "").isalpha():
            out.add(w)
            out.update(w[:n] + "*" for n in STEMS if n < len(w))
    return out


def _text_counts(rows: DataFrame, only: set | None) -> dict[str, int]:
    """In how many texts an entry occurs, counted in the tasks first."""
    def count(batches):
        n = Counter()
        for b in batches:
            for raw in as_bytes(b.column(0)):
                e = _entries(raw)
                n.update(e if only is None else e & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["e", "n"])
    got = rows.select("text").mapInArrow(count, "e string, n long").groupBy("e").agg(F.sum("n").alias("n"))
    return {r["e"]: r["n"] for r in got.where(F.col("n") >= (MIN_TEXTS if only is None else 1)).collect()}


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Entries (words, or starts of words ending in *) with their weights.
    ``labelled``: (text, toxic), at most MAX_LABELLED rows."""
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}
    toxic = _text_counts(labelled.where("toxic = 1"), None)
    clean = _text_counts(labelled.where("toxic = 0"), set(toxic))
    out = {}
    for e, a in toxic.items():
        b = clean.get(e, 0)
        odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
        if odds >= MIN_LOG_ODDS and a >= MIN_TEXTS + b // 4:
            out[e] = min(odds, 6.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; the first weight
    is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += d
        if np.abs(d).max() < 1e-8:
            break
    return w


BUILT_IN_FIT = np.array([-4.0, 1.0, 0.5, 0.5, 1.0])


def learn(docs: DataFrame, labels: DataFrame, allowed=None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> tuple[dict, np.ndarray]:
    """(lexicon, weights) from labelled rows whose id the Column ``allowed``
    (over ``doc_id``) accepts; all of them up to ``max_labelled``, then by hash."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if allowed is not None:
        marks = marks.where(allowed)
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(marks), "doc_id").select("text", "toxic")      # max_labelled pairs at most
    rows = rows.dropDuplicates(["text", "toxic"])                              # a copied text is one example
    lexicon = learn_lexicon(rows)
    at = _features(rows.select(F.col("toxic").alias("doc_id"), "text"), lexicon, "int").collect()
    if len({r[0] for r in at}) < 2:
        return lexicon, BUILT_IN_FIT
    at = np.array([tuple(r) for r in at], dtype=float)
    return lexicon, fit(at[:, 1:], at[:, 0])


def _features(rows: DataFrame, lexicon: dict, id_type: str) -> DataFrame:
    def run(batches):
        grammar = Grammar(lexicon)
        for b in batches:
            f = [grammar.features(raw) for raw in as_bytes(b.column(1))]
            cols = list(zip(*f)) if f else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in cols)],
                                             ["doc_id", "top", "total", "clauses", "share"])
    return rows.mapInArrow(run, f"doc_id {id_type}, top double, total double, clauses double, share double")


def score(docs: DataFrame, lexicon: dict, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and the clause features, one row per document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _features(rows, lexicon, rows.schema["doc_id"].dataType.simpleString())
    w = [float(x) for x in weights]
    z = F.lit(w[0]) + sum((F.col(c) * w[i] for i, c in enumerate(("top", "total", "clauses", "share"), 1)), F.lit(0.0))
    return out.withColumn("score", 1 / (1 + F.exp(-z)))
