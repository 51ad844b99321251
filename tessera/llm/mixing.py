"""Operator 6: mix sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (by a seeded hash) into one stream of
words and cut into blocks of ``BLOCK_WORDS``.  Slot t of the mix takes the van
der Corput point of t, looks it up in the cumulative target shares, and so
names a source; the k-th slot of a source takes that source's k-th block, and
the stream starts again when it ends.  Every prefix of the mix is thus close
to the weights.  What a document gives is read off the join of slots with
blocks; ``sequence`` is that join, the mix in its order.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, ...; they
share all words by weight; a target stops at ``MAX_REPEATS`` times the words
of its source and the excess is shared again by weight.

Scale: only (row, source, size) and, per block, (row, words) are shuffled, never
texts; slots and blocks meet on (source, block number), which no source skews.
The table of sources, one row each, is on the driver.  A source's stream
is cut by hash into ranges, so word positions come from a window inside a
(source, range) and a carry over ranges; slots are ranked inside fixed runs of
slots with a carry over runs.  No window covers a whole source.

Defined cases: null and empty texts have size 0 and are never taken; a null
id is hashed as any other value; rows equal in id and text are one after the
other in the stream, each with its own words; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

MAX_REPEATS = 3
BLOCK_WORDS = 50
SLOT_RUN = 4096                   # slots ranked together
RANGE_ROWS = 4096                 # documents of a source ordered together, about
SPACE = "[\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of other characters than space and \\t to \\r."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def targets(sizes: dict, max_repeats: int = MAX_REPEATS) -> dict:
    """source -> words it should give.  ``sizes``: source -> words it has."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    cap = {s: float(max_repeats * sizes[s]) for s in names}
    out, left, open_ = {}, float(sum(sizes.values())), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not full:
            out.update({s: left * weight[s] / total for s in open_})
            break
        out.update({s: cap[s] for s in full})
        left -= sum(cap[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def schedule(spark, shares: list[tuple[int, float]], n_slots: int) -> DataFrame:
    """(slot, source number, rank of the slot within its source) for all slots.
    ``shares``: (source number, share of the mix), positive shares only."""
    # van der Corput in base 2: the bits of the slot number, mirrored
    point = F.reverse(F.lpad(F.conv(F.col("slot").cast("string"), 10, 2), 48, "0"))
    point = F.conv(point, 2, 10).cast("long") / F.lit(float(1 << 48))
    numbers = np.array([n for n, _ in shares], np.int32)
    edges = np.cumsum([share for _, share in shares])[:-1]       # the last source has what is left

    def look_up(batches):
        for b in batches:
            at = np.searchsorted(edges, b.column(1).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers[at], pa.int32())], ["slot", "source_no"])
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("point")).mapInArrow(look_up, "slot long, source_no int")
    slots = slots.withColumn("run", F.floor(F.col("slot") / SLOT_RUN))
    inside = Window.partitionBy("source_no", "run").orderBy("slot")
    # runs before this one: one row per (source, run)
    runs = slots.groupBy("source_no", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("source_no", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (slots.withColumn("k", F.row_number().over(inside) - 1).join(runs, ["source_no", "run"])
            .select("slot", "source_no", (F.col("base") + F.col("k")).alias("rank")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block_words: int = BLOCK_WORDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows, slots).  rows: doc_id, source, tie, size, source_size, target,
    stream_start, taken, one per input row; slots: the schedule, with the block
    of the source's stream that each slot takes and the repeat it is from."""
    rows, slots, given = _plan(docs, id_col, text_col, source_col, block_words, seed)
    taken = given.groupBy("rid").agg(F.sum("words").alias("taken"))
    rows = rows.join(taken, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    first = F.col("rank") * block_words
    slots = slots.select("slot", "source", (first % F.col("source_size")).alias("block_start"),
                         F.floor(first / F.col("source_size")).alias("repeat"))
    return rows.select("doc_id", "source", "tie", "size", "source_size", "target", "stream_start", "taken"), slots


def sequence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """The mix itself: (slot, at, source, doc_id, tie, first_word, words).  Slots
    in order, and inside a slot its parts by ``at``, are the words of the mix."""
    rows, _, given = _plan(docs, id_col, text_col, source_col, block_words, seed)
    return given.join(rows.select("rid", "source", "doc_id", "tie"), "rid").select("slot", "at", "source", "doc_id", "tie", "first_word", "words")


def _plan(docs: DataFrame, id_col, text_col, source_col, block_words, seed):
    """rows, one per input row; slots (slot, source_no, rank, source, source_size);
    and what the slots take: (rid, slot, at, first_word, words)."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), n_words(text).alias("size"))
    rows = rows.withColumn("place", F.xxhash64("doc_id", "tie", F.lit(seed))).withColumn("rid", F.monotonically_increasing_id())
    rows = materialize(rows, "mix-sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).collect()
    sizes = {r["source"]: r["words"] for r in per_source}
    goal = targets(sizes)
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    total = sum(goal.values())
    shares = [(i, goal[s] / total) for i, s in enumerate(names) if total > 0 and goal[s] > 0]
    n_slots = -(-int(total) // block_words) if shares else 0
    slots = materialize(schedule(spark, shares, n_slots), "mix-slots") if shares else spark.createDataFrame([], "slot long, source_no int, rank long")
    # blocks each source gives: the ranks 0 .. n-1 of its slots
    counts = {r["source_no"]: r["n"] for r in slots.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = spark.createDataFrame(
        [(i, s, sizes[s], goal[s], counts.get(i, 0)) for i, s in enumerate(names)],
        "source_no int, source_ string, source_size long, target double, slots long")
    # the stream: place in hash order, in ranges of about RANGE_ROWS documents
    most = max([r["docs"] for r in per_source], default=1)
    width = max(1, 2 ** 64 // max(1, most // RANGE_ROWS))
    rows = rows.withColumn("part", F.floor(F.col("place") / F.lit(float(width))).cast("long"))
    inside = (Window.partitionBy("source", "part").orderBy("place", F.col("doc_id").asc_nulls_first(), "tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s_"), F.col("part").alias("p_"),
                         F.coalesce(F.sum("words").over(before), F.lit(0)).alias("outer"))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("s_")) & (F.col("part") == F.col("p_")))
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("source_")))
    rows = rows.select("rid", "doc_id", "source", "tie", "size", "source_size", "target", "source_no", "slots",
                       (F.col("outer") + F.col("inner")).cast("long").alias("stream_start"))
    slots = slots.join(per.select("source_no", F.col("source_").alias("source"), "source_size"), "source_no")
    # every time the stream comes round, a document's words lie in these blocks
    start = F.col("stream_start") + F.col("repeat") * F.col("source_size")
    parts = rows.where("size > 0 and slots > 0").withColumn("repeat", F.explode(F.array(*map(F.lit, range(MAX_REPEATS)))))
    parts = parts.select("rid", "source_no", "size", "slots", start.alias("start")).withColumn("low", F.expr(f"start div {block_words}"))
    parts = parts.where("low < slots").withColumn("high", F.least(F.expr(f"(start + size - 1) div {block_words}"), F.col("slots") - 1))
    parts = parts.select("rid", "source_no", "size", "start", F.explode(F.sequence("low", "high")).alias("rank"))
    given = parts.join(slots.select("source_no", "rank", "slot"), ["source_no", "rank"])
    low = F.greatest("start", F.col("rank") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("rank") + 1) * block_words)
    given = given.select("rid", "slot", (low - F.col("rank") * block_words).alias("at"), (low - F.col("start")).alias("first_word"),
                         (high - low).alias("words"))
    return rows, slots, given


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it: the words
    taken over the words it has, rounded (half up).  Rows that the mix takes
    less than half of are left out."""
    rows, _ = mix(docs, id_col, text_col, source_col, block_words, seed)
    # rows equal in id and text share what is taken of them
    per = rows.where("size > 0").groupBy("doc_id", "tie", "source").agg(
        F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("_mix_times"))
    per = per.where("_mix_times > 0").select(F.col("doc_id").alias("_mix_id"), F.col("tie").alias("_mix_tie"),
                                             F.col("source").alias("_mix_source"), "_mix_times")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = (F.col(id_col).cast("long").eqNullSafe(F.col("_mix_id")) & (F.xxhash64(text) == F.col("_mix_tie"))
            & F.col(source_col).cast("string").eqNullSafe(F.col("_mix_source")))
    out = docs.join(per, same).withColumn("_mix_n", F.explode(F.sequence(F.lit(1), F.col("_mix_times"))))
    return out.select(*(docs[c] for c in docs.columns))
