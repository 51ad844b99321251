"""Operator 7: near duplicates by DartMinHash over five-word shingles.

A text is a bag of shingles; the weight of a shingle is how often it occurs.
The region of an element of weight w is cut into unit cells.  Every cell
throws hashed darts at increasing ranks (a Poisson process whose gaps come
from the hash of cell and dart number), each dart names one of ``K``
coordinates, and the earliest dart of a coordinate is the signature there.
Two texts agree in a coordinate with the probability of their weighted
Jaccard similarity.  Only darts up to a rank at which about ``DARTS`` of them
have landed in the whole text are thrown, so a text of n shingles costs about
n + DARTS steps instead of n * K; texts with an empty coordinate go on at
twice the rank.  For a fractional weight the last cell keeps the darts whose
position lies below the weight.

Grouping: texts with equal words are one class first, so copies are compared
once.  Class representatives meet in ``BANDS`` bands of ``ROWS`` coordinates.
A bucket compares each member with one hub (n - 1 pairs, not n * n) and linked
members form groups.  A link can then be missing only between members of
different groups in one bucket: such buckets get other hubs, and at last each
member outside a bucket's largest group is tested, inside the join, against the
members of other groups; one link to each group goes on, which is all that the
group needs.  Links found later join groups, not texts: only their roots are
gone through again.  Every link is decided by the exact weighted Jaccard
similarity of two texts.

Defined cases: texts of one to four words have one shingle, all their words;
null and empty texts have none and stay alone; repeated rows are one class; a
row with a null id takes part like any other, and a class without any id has a
null class id; other columns are not read, so they cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import drop_scratch, scratch_path
from .common import as_bytes, mix64, word_hashes

WINDOW = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5                    # a link at 0.8 is missed with 7e-5, at 0.85 with 1e-6
K = BANDS * ROWS
DARTS = int(K * (np.log(K) + 6))       # an empty coordinate is then rare
HUB_ORDERS = 3
SPLIT = 4096                           # members of a bucket whose minor ones share a task
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], hashes=None) -> np.ndarray:
    """64-bit hashes of the five-word windows in text order (all words, if fewer)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = word_hashes(words) if hashes is None else hashes
    width = min(WINDOW, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = mix64(out * _ODD + h[k:n - width + 1 + k])
    return out


class WordHasher:
    """Word hashes with a bounded memory of words met before."""

    def __init__(self, most: int = 400_000):
        import xxhash
        self.of, self.most, self.cache = xxhash.xxh64_intdigest, most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.cache) > self.most:
            self.cache.clear()
        for w in set(words).difference(self.cache):
            self.cache[w] = self.of(w)
        return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64-bit hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53


def signatures(elements: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = K,
               darts: int = DARTS) -> np.ndarray:
    """Signature matrix (texts x k, uint64) of non-empty weighted sets.
    Without weights every array is a bag: an element weighs its occurrences."""
    doc, elem, cell, limit = [], [], [], []
    for i, e in enumerate(elements):
        if weights is None:
            order = np.sort(e)
            first = np.concatenate(([True], order[1:] != order[:-1]))
            number = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            el, last = order, np.ones(len(order))
        else:
            w = np.asarray(weights[i], float)
            n = np.ceil(w).astype(int)
            el = np.repeat(e, n)
            number = np.arange(len(el)) - np.repeat(np.cumsum(n) - n, n)
            last = np.minimum(1.0, np.repeat(w, n) - number)
        doc.append(np.full(len(el), i))
        elem.append(el)
        cell.append(number)
        limit.append(last)
    n_docs = len(elements)
    sig = np.zeros((n_docs, k), np.uint64)
    if not n_docs:
        return sig
    doc, elem, limit = np.concatenate(doc), np.concatenate(elem), np.concatenate(limit)
    cell = mix64(elem ^ mix64(np.concatenate(cell).astype(np.uint64) + _ODD))
    total = np.bincount(doc, weights=limit, minlength=n_docs)
    rank_to = darts / total
    todo = np.arange(n_docs)
    while len(todo):
        mine = np.isin(doc, todo) if len(todo) < n_docs else slice(None)
        d, c, lim = doc[mine], cell[mine], limit[mine]
        whole = bool((lim == 1).all())          # then every dart lies below the weight
        at, to, number = np.zeros(len(d)), rank_to[d], 0
        got_key, got_rank, got_dart = [], [], []
        while len(d):
            number += 1
            dart = mix64(c + np.array([number], np.uint64) * _ODD)
            at = at - np.log(_unit(dart))
            near = np.flatnonzero(at <= to)
            d, c, at, to, dart = d[near], c[near], at[near], to[near], dart[near]
            place = mix64(dart ^ _ODD)
            key, rank, hit = d * k, at, dart
            key += (mix64(place + _ODD) % np.uint64(k)).view(np.int64)
            if not whole:
                lim = lim[near]
                ok = _unit(place) <= lim
                key, rank, hit = key[ok], rank[ok], hit[ok]
            got_key.append(key)
            got_rank.append(rank)
            got_dart.append(hit)
        key, rank, dart = map(np.concatenate, (got_key, got_rank, got_dart))
        # the earliest dart of each coordinate, of equally early ones the smallest
        best = np.full(n_docs * k, np.inf)
        np.minimum.at(best, key, rank)
        first = np.flatnonzero(rank == best[key])
        key, dart = key[first], dart[first]
        flat = sig.reshape(-1)
        flat[key] = np.uint64(2 ** 64 - 1)
        np.minimum.at(flat, key, dart)
        filled = (best < np.inf).reshape(n_docs, k).sum(axis=1)
        todo = todo[filled[todo] < k]
        rank_to[todo] *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per text and band."""
    out = np.tile(mix64(np.arange(1, bands + 1, dtype=np.uint64) * _ODD), (len(sig), 1))
    for r in range(rows):
        out = mix64(out * _ODD + sig[:, r::rows][:, :bands])
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted bags of shingles."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[ia], cb[ib]).sum())
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, words_key, keys): keys null where the text has no word."""
    def run(batches):
        hasher = WordHasher()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                words = [x.split() for x in as_bytes(part.column(1))]
                full = [j for j, w in enumerate(words) if w]
                bags = [shingles(words[j], hasher(words[j])) for j in full]
                keys: list = [None] * len(words)
                texts: list = [None] * len(words)
                for j, bag, row in zip(full, bags, band_keys(signatures(bags)).view(np.int64)):
                    keys[j] = row
                    texts[j] = _text_key(words[j])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()),
                                                  pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "words_key", "keys"])
    return docs.mapInArrow(run, "doc_id long, words_key binary, keys array<long>")


def _text_key(words: list[bytes]) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(b" ".join(words))


def _store(df: DataFrame, name: str, made: list) -> DataFrame:
    """``df`` written as a scratch table, whose path is added to ``made``."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    made.append(path)
    return df.sparkSession.read.parquet(path)


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text), one row for each (rep, doc_id) of ``wanted``."""
    found = rows.join(wanted, "doc_id").select("rep", "text")

    def run(batches):
        for b in batches:                 # an id may also stand for other texts
            same = [_text_key(x.split()) == k for k, x in zip(b.column(0).to_pylist(), as_bytes(b.column(1)))]
            yield b.filter(pa.array(same, pa.bool_()))

    def key(batches):
        for b in batches:
            keys = [_text_key(x.split()) for x in as_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0)], ["rep", "text"])
    found = found.mapInArrow(run, "rep binary, text string")
    nameless = rows.where("doc_id is null").select("text").mapInArrow(key, "rep binary, text string")
    nameless = nameless.join(wanted.where("doc_id is null").select("rep"), "rep", "left_semi")
    return found.unionByName(nameless).groupBy("rep").agg(F.first("text").alias("text"))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, sim) of the pairs (a, b); ``texts``: (rep, text) of their members."""
    ta = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        hasher, last, last_bag = WordHasher(), None, None
        for batch in batches:
            sims = []
            for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                if x != last:                       # pairs of one hub often follow one another
                    w = x.split()
                    last, last_bag = x, shingles(w, hasher(w))
                w = y.split()
                sims.append(similarity(last_bag, shingles(w, hasher(w))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"])
    return rows.mapInArrow(run, "a binary, b binary, sim double")


def connected(links: DataFrame, made: list | None = None, max_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node of its component, for all nodes of
    ``links`` (a, b).  Smallest neighbour, then pointer jumping, until stable."""
    made, spark = [] if made is None else made, links.sparkSession
    both = _store(links.select("a", "b").union(links.select("b", "a")).distinct(), "links", made)
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    label = _store(label, "labels", made)
    for _ in range(max_rounds):
        near = (both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("near")))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = (label.join(near, "node").join(up, "root", "left")
               .select("node", F.col("root").alias("old"), F.least("root", "near", "up").alias("root")))
        before = made.pop()
        new = _store(new, "labels", made)
        label = new.select("node", "root")
        settled = not new.where("old <> root").limit(1).count()
        drop_scratch(spark, before)              # the labels before: read for the last time
        if settled:
            return label
    raise RuntimeError("components did not settle")


def _joined(groups: DataFrame, links: DataFrame, made: list) -> DataFrame:
    """(node, root) of ``groups`` with more links: only the roots that the links
    touch are gone through."""
    at = lambda c: groups.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    ends = links.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    a, b = F.coalesce("root_a", "a"), F.coalesce("root_b", "b")
    up = connected(ends.select(a.alias("a"), b.alias("b")).where("a <> b").distinct(), made)
    old = groups.join(up.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
    old = old.select("node", F.coalesce("up", "root").alias("root"))
    return _store(old.unionByName(up.join(groups, "node", "left_anti").select("node", "root")), "groups", made)


def _hub_pairs(members: DataFrame, salt: int) -> DataFrame:
    """In each bucket, a hub against every other member.  The hub is the member
    of least hash in one of ``HUB_ORDERS`` orders, taken in turn over the bands,
    so that texts alike meet again under another hub."""
    order = F.xxhash64("rep", F.pmod(F.col("band"), F.lit(HUB_ORDERS)) + F.lit(salt))
    hubs = members.groupBy("band", "key").agg(F.min_by("rep", F.struct(order, F.col("rep"))).alias("hub"))
    pairs = members.join(hubs, ["band", "key"]).where("rep <> hub")
    return pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def _mixed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (band, key, rep, root, minor) of the buckets that hold more than
    one component; minor: not in the largest of them."""
    at = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    at = at.withColumn("root", F.coalesce("root", "rep"))
    per = at.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("band", "key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("groups"))
    at = at.join(per.where("groups > 1"), ["band", "key"])
    return at.select("band", "key", "rep", "root", (F.col("root") != F.col("main")).alias("minor"))


def _cells(texts: DataFrame) -> DataFrame:
    """(rep, n, cells, repeats): a 64-bit hash of every unit cell of the text's
    bag, and how many of them equal another one before."""
    def run(batches):
        hasher = WordHasher()
        for b in batches:
            bags = [np.sort(shingles(w, hasher(w))) for w in (x.split() for x in as_bytes(b.column(1)))]
            cells = []
            for bag in bags:
                at = np.arange(len(bag))
                number = at - np.maximum.accumulate(np.where(np.concatenate(([True], bag[1:] != bag[:-1])), at, 0))
                cells.append(mix64(bag ^ mix64(number.astype(np.uint64) + _ODD)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, bags)), pa.int32()),
                                              pa.array(cells, pa.list_(pa.int64())),
                                              pa.array([len(c) - len(np.unique(c)) for c in cells], pa.int32())], ["rep", "n", "cells", "repeats"])
    return texts.select("rep", "text").mapInArrow(run, "rep binary, n int, cells array<long>, repeats int")


def _cross_pairs(mixed: DataFrame, reps: DataFrame, texts: DataFrame, min_similarity: float) -> DataFrame:
    """Links between a minor member and members of other components that share a
    bucket with it and are similar enough: one for each member and component,
    taken where they are found, before any shuffle.  The test is part of the
    join.  It is the exact similarity on 64-bit cells; repeated ones, which the
    intersection drops, are added, so no similar pair is refused.  A pair is
    tested in its first common band; the minor members of a large bucket are
    spread over several tasks."""
    cells = _cells(texts.join(mixed.select("rep").distinct(), "rep", "left_semi"))
    per = mixed.groupBy("band", "key").agg((F.floor(F.count(F.lit(1)) / SPLIT) + 1).cast("int").alias("splits"))
    at = mixed.join(per, ["band", "key"]).join(reps.select("rep", "keys"), "rep").join(cells, "rep")
    side = lambda s: [F.col(c).alias(c + s) for c in ("rep", "root", "keys", "n", "cells", "repeats")]
    x = at.where("minor").select("band", "key", F.pmod(F.xxhash64("rep"), "splits").cast("int").alias("split"), *side("_x"))
    y = at.select("band", "key", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), *side("_y"))
    first = F.array_position(F.zip_with("keys_x", "keys_y", lambda p, q: p == q), True) == F.col("band") + 1
    both = F.size(F.array_intersect("cells_x", "cells_y")) + F.least("repeats_x", "repeats_y")
    alike = both >= min_similarity * (F.col("n_x") + F.col("n_y") - both)
    near = F.least("n_x", "n_y") >= min_similarity * F.greatest("n_x", "n_y")
    test = F.when(F.col("root_x") == F.col("root_y"), False).when(~near, False).when(~first, False).otherwise(alike)
    found = x.join(y, ["band", "key", "split"]).where(test).groupBy("rep_x", "root_y").agg(F.min("rep_y").alias("rep_y"))
    return found.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_similarity: float = SIMILARITY,
            with_words: bool = False) -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest doc_id of its
    group) and copy_of (the smallest doc_id whose words are equal); with
    ``with_words`` also words_key and group_key, null where the text has no word."""
    made: list = []
    rows = _keyed(docs, id_col, text_col)
    sketch = _store(_sketch(rows), "sketch", made)
    # one representative per distinct word sequence; copies end here
    reps = sketch.where("keys is not null").groupBy(F.col("words_key").alias("rep")).agg(
        F.first("keys").alias("keys"), F.min("doc_id").alias("doc_id"))
    reps = _store(reps, "reps", made)
    buckets = reps.select("rep", "doc_id", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = _store(buckets.join(shared, ["band", "key"]), "buckets", made)
    texts = _store(_texts(rows, members.select("rep", "doc_id").distinct()), "texts", made)
    members = members.drop("doc_id")
    checked = _store(_verify(_hub_pairs(members, 0), texts), "checked", made)
    close = F.col("sim") >= min_similarity
    groups = connected(checked.where(close), made)
    # again with other hubs, in the buckets that hold several components
    mixed = _store(_mixed(members, groups), "mixed", made)
    new = _hub_pairs(mixed, HUB_ORDERS).join(checked.select("a", "b"), ["a", "b"], "left_anti")
    again = _store(_verify(new, texts), "checked", made)
    if again.where(close).limit(1).count():
        groups = _joined(groups, again.where(close), made)
        mixed = _store(_mixed(mixed.select("band", "key", "rep"), groups), "mixed", made)
    # what is left: members of one bucket in different components
    rest = _store(_verify(_cross_pairs(mixed, reps, texts, min_similarity), texts), "checked", made)
    if rest.where(close).limit(1).count():
        groups = _joined(groups, rest.where(close), made)
    named = reps.select("rep", "doc_id").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("root", F.coalesce("root", "rep"))
    first = named.groupBy("root").agg(F.min("doc_id").alias("class_of"))
    named = named.join(first, "root").select(F.col("rep").alias("words_key"), F.col("doc_id").alias("copy_"), "class_of",
                                              F.col("root").alias("group_key"))
    out = sketch.select("doc_id", "words_key").join(named, "words_key", "left")
    out = _store(out.select("doc_id", F.coalesce("class_of", "doc_id").alias("class_id"),
                            F.coalesce("copy_", "doc_id").alias("copy_of"), *["words_key", "group_key"] * with_words), "classes", made)
    drop_scratch(docs.sparkSession, *made[:-1])
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the class id of their
    group; of rows repeated with equal id and words one stays, and rows of one
    id with different words are told apart.  Rows with a null id stay."""
    found = classes(docs, id_col, text_col, with_words=True)
    is_first = F.col("doc_id") == F.col("class_id")
    keep = _store(found.groupBy(F.col("doc_id").alias("_keep_id")).agg(F.count(F.lit(1)).alias("_rows"), F.max(is_first).alias("_first"))
                  .where("_first"), "keep", [])
    id_ = F.col(id_col).cast("long")
    stay = docs.join(keep.where("_rows = 1").select("_keep_id"), id_ == F.col("_keep_id"), "left_semi")
    # ids that stand for several rows: one row of each group, found by its words
    several = keep.where("_rows > 1").select("_keep_id")
    if several.limit(1).count():
        rows = docs.join(several, id_ == F.col("_keep_id"), "left_semi")
        names = [f"_c{i}" for i in range(len(docs.columns))]
        at = docs.columns.index(text_col)

        def key(batches):
            for b in batches:
                words = [_text_key(x.split()) for x in as_bytes(b.column(at).cast(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words, pa.binary())], [*names, "_words"])
        fields = [StructField(n, f.dataType) for n, f in zip(names, docs.schema)] + [StructField("_words", BinaryType())]
        rows = rows.mapInArrow(key, StructType(fields))
        i = names[docs.columns.index(id_col)]
        wanted = found.where(is_first).join(several, F.col("doc_id") == F.col("_keep_id")).groupBy("_keep_id", "group_key").agg(
            F.coalesce(F.min("words_key"), F.lit(_text_key([]))).alias("_keep_words"))
        rows = rows.join(wanted, (F.col(i).cast("long") == F.col("_keep_id")) & (F.col("_words") == F.col("_keep_words")), "left_semi")
        # of rows that differ in other columns only, always the same one
        one = F.min_by(F.struct(*names), F.xxhash64(F.to_json(F.struct(*names))))
        rows = rows.groupBy(i, "_words").agg(one.alias("_row")).select("_row.*").toDF(*docs.columns)
        stay = stay.unionByName(rows)
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
