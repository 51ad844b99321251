"""Operator 12: spelling variants by a variable-length gram index.

Words are counted over all texts.  Two words are near if one inserted, deleted
or replaced code point turns one into the other.  Near pairs are found by grams
of variable length:

* Dictionary: a gram of ``SHORTEST`` code points is always one; a gram is made
  one longer while it begins frequently, that is, in more than 1 of
  ``FREQUENT`` of all places of the words (and up to ``LONGEST``).  So there are
  fewer than ``FREQUENT`` frequent grams of each length, however many words
  there are; they alone are sent to the tasks.
* Decomposition: at each place of a word stands the longest gram of the
  dictionary, so frequent beginnings have longer, rarer grams.
* Bound: an edit changes only the grams that cover its place.  The most that one
  edit can change, a number of the word, leaves ``bound`` grams in both words,
  at the same place or shifted by the difference of the lengths.  With lengths
  from 2 to 4 a word of six code points keeps one at least, so every near pair
  shares a gram.
* Lists: of ``n`` grams, ``bound`` of which are kept, one of the ``n - bound + 1``
  rarest is kept too, in both words.  Only these are listed, by gram, length
  of the longer word and place.  Words that meet in a list are tested in the join on
  the edit distance itself, so only near pairs leave it.

Each word takes as its form the near word of largest count, if that is
``RATIO`` times its own; forms are followed to the last by pointer jumping.

Defined cases: null and empty texts hold no run; a null id stands as the empty
string in what is hashed; repeated rows count as often as they stand; other
columns are not read, so they cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
SHORTEST, LONGEST = 2, 4
FREQUENT = 5000
#: Fixed values of the data contract: what a run is, and its one letter dropped now and then.
RUN = "[A-Za-zÀ-ÿ]+"
DROP_EVERY = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def dropped_letter(id_: Column, word: Column) -> Column:
    """The word, without one code point where the hash of id and word says so."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(h % DROP_EVERY == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of the texts."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select("id", lower_ascii(F.col("run")).alias("run")).where(F.length("run") >= least_length)
    words = words.select(dropped_letter(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, frequent: int = FREQUENT) -> dict[str, int]:
    """Grams of ``shortest`` to ``longest - 1`` code points that stand in more than
    1 of ``frequent`` places, with the number of places: under ``frequent`` of each length."""
    places = words.agg(F.sum(F.length("word") - (shortest - 1))).first()[0] or 0
    def of_size(size):
        return F.transform(F.sequence(F.lit(1), F.length("word") - (size - 1)), lambda i: F.substr("word", i, F.lit(size)))
    each = [of_size(size) for size in range(shortest, longest)]
    grams = words.where(F.length("word") >= longest).select(F.explode(F.concat(*each)).alias("gram"))
    found = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * frequent > places)
    return {r["gram"]: r["n"] for r in found.collect()}


def decompose(word: str, frequent, shortest: int = SHORTEST, longest: int = LONGEST) -> tuple[list[str], int]:
    """(gram at each place, bound): the grams of the word, and how many of them
    any one edit leaves unchanged."""
    n = len(word)
    grams = []
    hit = [0] * (n + 2)          # changes in the number of grams touched by an edit of code point e ...
    gap = [0] * (n + 3)          # ... and by one inserted before code point e
    for p in range(n - shortest + 1):
        end = p + shortest
        while end - p < longest and word[p:end] in frequent:
            if end == n:         # cut by the word's end: a letter added there would make it longer
                end += 1
                break
            end += 1
        stop = min(end, n)
        grams.append(word[p:stop])
        hit[p] += 1
        hit[stop] -= 1
        gap[p + 1] += 1
        gap[end] -= 1
    worst = now = 0
    for e in range(n):
        now += hit[e]
        worst = max(worst, now)
    now = 0
    for e in range(n + 1):
        now += gap[e]
        worst = max(worst, now)
    return grams, len(grams) - worst


def _decomposed(words: DataFrame, frequent: frozenset, shortest: int, longest: int) -> DataFrame:
    """(word, n, grams, bound)"""
    def run(batches):
        for b in batches:
            cut = [decompose(w, frequent, shortest, longest) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g for g, _ in cut], pa.list_(pa.string())),
                                              pa.array([k for _, k in cut], pa.int32())], ["word", "n", "grams", "bound"])
    return words.select("word", "n").mapInArrow(run, "word string, n long, grams array<string>, bound int")


def _listed(cut: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, n, len, gram, place): the rarest grams of each word, one of which
    every near word lists too."""
    rows = cut.select("word", "n", "bound", F.posexplode("grams").alias("place", "gram")).join(counts, "gram")
    rare = F.array_sort(F.collect_list(F.struct("uses", "gram", "place")))
    rows = rows.groupBy("word", "n", "bound").agg(rare.alias("g"))
    first = F.slice("g", F.lit(1), F.greatest(F.size("g") - F.col("bound") + 1, F.lit(1)))
    return rows.select("word", "n", F.length("word").alias("len"), F.inline(first)).drop("uses")


def near_pairs(words: DataFrame, made: list | None = None, shortest: int = SHORTEST, longest: int = LONGEST, frequent: int = FREQUENT) -> DataFrame:
    """(a, n_a, b, n_b): each unordered pair of near words once.  ``words``
    (word, n) have at least ``shortest + longest`` code points each."""
    made = [] if made is None else made
    grams = frozenset(frequent_grams(words, shortest, longest, frequent))
    cut = _written(_decomposed(words, grams, shortest, longest), "grams", made)
    counts = cut.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    lists = _written(_listed(cut, counts), "lists", made)
    # the shorter word looks among words of its length at the same place, and among
    # longer ones at the same place or the next
    looks = F.array(F.struct(F.lit(0).alias("more"), F.lit(0).alias("shift")), F.struct(F.lit(1).alias("more"), F.lit(0).alias("shift")),
                    F.struct(F.lit(1).alias("more"), F.lit(1).alias("shift")))
    x = lists.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "gram", "len", "place", F.inline(looks))
    x = x.select("a", "n_a", "gram", (F.col("len") + F.col("more")).alias("len"), (F.col("place") + F.col("shift")).alias("place"))
    y = lists.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "gram", "len", "place")
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    pairs = x.join(y, ["gram", "len", "place"]).where(once & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "n_a", "b", "n_b").distinct()


def last_forms(forms: DataFrame, made: list) -> DataFrame:
    """(word, root) of the words with a form, by pointer jumping: the way to the
    last form halves in each round."""
    at = _written(forms.select("word", F.col("form").alias("root")), "roots", made)
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = _written(at.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")),
                       "roots", made)
        at = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return at


def _written(df: DataFrame, name: str, made: list) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    made.append(path)
    return df.sparkSession.read.parquet(path)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    if least_length < SHORTEST + LONGEST:
        raise ValueError(f"words of under {SHORTEST + LONGEST} code points may share no gram with a near word")
    made: list = []
    words = _written(count_words(docs, id_col, text_col, least_length, least_count), "words", made)
    pairs = _written(near_pairs(words, made), "near", made)
    both = pairs.select(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_a").alias("m"), F.col("a").alias("other")))
    best = F.min_by(F.struct("other", "m"), F.struct(-F.col("m"), F.col("other")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = words.join(near, "word", "left")
    takes = F.col("best.m") >= ratio * F.col("n")
    near = _written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(takes, F.col("best.other")).alias("form"), F.when(takes, F.col("best.m")).alias("form_n")), "variants", made)
    roots = last_forms(near.where("form is not null"), made)
    out = _written(near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants", made)
    drop_scratch(docs.sparkSession, *made[:-1])
    return out
