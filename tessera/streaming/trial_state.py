"""State of the trial streams, kept small: seen trial numbers as runs, and the
trend in two levels.

A study's trials are dealt over ``SLOTS`` slots by trial number modulo
``SLOTS``.  Inside a slot the numbers of a study that numbers its trials one
after another are consecutive again (number div ``SLOTS``), so what was seen is
one run however long the study lasts: the state of a study is a run in each
slot, plus one run per gap.  A study that holds most of the trials is
``SLOTS`` state groups, not one.

Studies share state groups: ``BUCKETS`` by the hash of the study in each slot.
A call of Python and a trip to the state store cost about the same for one
study as for thousands, so a batch costs as many of them as there are groups,
and inside a group the studies are gone through as arrays.

The operators use ``transformWithStateInPandas``; a session made by
``streaming.sinks.stream_session`` has the state store that this needs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import (ArrayType, BinaryType, DoubleType, LongType, StringType,
                               StructField, StructType)

from tessera.functions.fmt import TREND_SYMBOLS
from tessera.operators.trials import TREND_EPS, TREND_WINDOW, scored

SLOTS = 8
BUCKETS = 128                   # fixed in a stream's checkpoint, like its state partitions
_NONE = -(1 << 62)              # place of a row without trial number


def first_places(runs, groups: np.ndarray, places: np.ndarray):
    """Which (group, place) lie in none of ``runs`` and stand here for the first
    time, and the runs with these added; runs that touch become one.  ``runs``:
    arrays (group, lo, hi), disjoint, in the order of group and lo."""
    n = len(runs[0])
    group, lo, hi = (np.concatenate((r, x)) for r, x in zip(runs, (groups, places, places)))
    order = np.lexsort((lo, group))                        # stable: a run stands before a place at its start
    group, lo, hi = group[order], lo[order], hi[order]
    is_run, at = order < n, np.arange(len(order))
    last = np.maximum.accumulate(np.where(is_run, at, -1))
    inside = (last >= 0) & (group[last] == group) & (lo <= hi[last])
    again = np.concatenate(([False], (group[1:] == group[:-1]) & (lo[1:] == lo[:-1])))
    new = ~is_run & ~inside & ~again
    mask = np.zeros(len(places), bool)
    mask[order[new] - n] = True
    group, lo, hi = (x[is_run | new] for x in (group, lo, hi))
    start = np.concatenate(([True], (group[1:] != group[:-1]) | (lo[1:] > hi[:-1] + 1)))[:len(lo)]
    end = np.append(start[1:], True)[:len(lo)]
    return mask, (group[start], lo[start], hi[end])


def _one_group(runs: list[tuple[int, int]]):
    lo, hi = np.array(runs, np.int64).reshape(-1, 2).T
    return np.zeros(len(lo), np.int64), lo, hi


def unseen(runs: list[tuple[int, int]], places: np.ndarray) -> np.ndarray:
    """Which of ``places``, each given once, lie in none of the sorted, disjoint ``runs``."""
    return first_places(_one_group(runs), np.zeros(len(places), np.int64), places)[0]


def add_places(runs: list[tuple[int, int]], places: np.ndarray) -> list[tuple[int, int]]:
    """``runs`` with ``places`` added; runs that touch become one."""
    _, (_, lo, hi) = first_places(_one_group(runs), np.zeros(len(places), np.int64), places)
    return list(zip(lo.tolist(), hi.tolist()))


def _places(slots: int, buckets: int):
    """Bucket of a study, slot of a trial number, and its place inside the slot."""
    n = F.col("trial_number").cast("long")
    return [F.pmod(F.xxhash64("study"), F.lit(buckets)).cast("int").alias("bucket"),
            F.coalesce(F.pmod(n, F.lit(slots)), F.lit(-1)).cast("int").alias("slot"),
            F.coalesce(F.floor(n / slots).cast("long"), F.lit(_NONE)).alias("place")]


class _Table:
    """Rows of a state group as one value of Arrow bytes: a column ``study`` and others."""

    def __init__(self, handle, name: str, **others):
        import pyarrow as pa
        self.schema = pa.schema({"study": pa.string(), **others})
        self.value = handle.getValueState(name, StructType([StructField("rows", BinaryType())]))

    def get(self) -> list[np.ndarray]:
        import pyarrow as pa
        if not self.value.exists():
            return [np.array([], object if f.name == "study" else f.type.to_pandas_dtype()) for f in self.schema]
        t = pa.ipc.open_stream(bytes(self.value.get()[0])).read_all()
        return [c.to_numpy() for c in t.columns]

    def put(self, columns) -> None:
        import pyarrow as pa
        arrays = [pa.array(c, f.type, from_pandas=f.name == "study") for c, f in zip(columns, self.schema)]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as out:
            out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.value.update((sink.getvalue().to_pybytes(),))


def _numbered(*studies):
    """Numbers of the studies of several arrays in the order in which they come, and the studies by number."""
    import pandas as pd
    codes, names = pd.factorize(np.concatenate([np.asarray(s, object) for s in studies]), use_na_sentinel=False)
    return np.split(codes, np.cumsum([len(s) for s in studies])[:-1]), names


class _Seen:
    """First rows of (study, place) not met before, batch by batch."""

    def __init__(self, handle):
        import pyarrow as pa
        self.runs = _Table(handle, "seen", lo=pa.int64(), hi=pa.int64())

    def first_rows(self, rows):
        study, lo, hi = self.runs.get()
        changed = False
        for pdf in rows:
            if pdf.empty:
                continue
            (of_run, of_row), names = _numbered(study, pdf["key"])
            new, (group, lo_, hi_) = first_places((of_run, lo, hi), of_row, pdf["place"].to_numpy())
            if new.any():
                changed, study, lo, hi = True, names[group], lo_, hi_
                yield pdf[new]
        if changed:
            self.runs.put((study, lo, hi))


class FirstRows(StatefulProcessor):
    """Each (study, trial_number) once, however late it comes."""

    def __init__(self, columns):
        self.columns = columns

    def init(self, handle):
        self.seen = _Seen(handle)

    def handleInputRows(self, key, rows, timerValues):
        for pdf in self.seen.first_rows(rows):
            yield pdf[self.columns]

    def close(self):
        pass


def _keyed(trials: DataFrame, columns, slots: int, buckets: int):
    """``columns`` with the study as ``key`` and the place, by bucket and slot."""
    return trials.select(*columns, F.col("study").alias("key"), *_places(slots, buckets)).groupBy("bucket", "slot")


def first_rows(trials_stream: DataFrame, slots: int = SLOTS, mode: str = "Append", buckets: int = BUCKETS) -> DataFrame:
    """The first row of every (study, trial_number), all columns; ``mode`` is the
    output mode of the query it stands in."""
    # inside, columns go by place: the worker accepts only names that a Python tuple can have
    names = [f"c{i}" for i in range(len(trials_stream.columns))]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, trials_stream.schema)])
    keyed = _keyed(trials_stream, [F.col(c).alias(n) for c, n in zip(trials_stream.columns, names)], slots, buckets)
    return keyed.transformWithStateInPandas(FirstRows(names), schema, mode, "None").toDF(*trials_stream.columns)


_SLOT_OUT = StructType([StructField("study", StringType()), StructField("slot", LongType()), StructField("completed", LongType()),
                        StructField("numbers", ArrayType(LongType())), StructField("scores", ArrayType(DoubleType()))])


class SlotWindow(StatefulProcessor):
    """Of one slot: how many trials of each study completed, and the last ``w`` of them."""

    def __init__(self, w):
        self.w = w

    def init(self, handle):
        import pyarrow as pa
        self.seen = _Seen(handle)
        self.last = _Table(handle, "last", completed=pa.int64(), number=pa.int64(), score=pa.float64())

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        study, completed, number, score = self.last.get()   # a row for each trial kept; completed is the study's
        touched = []
        for pdf in self.seen.first_rows(rows):
            pdf = pdf[pdf["done"] & pdf["trial_number"].notna()]
            if pdf.empty:
                continue
            (old, new), names = _numbered(study, pdf["key"])
            before = np.zeros(len(names), np.int64)
            before[old] = completed
            count = before + np.bincount(new, minlength=len(names))
            group = np.concatenate((old, new))
            number = np.concatenate((number, pdf["trial_number"].to_numpy(np.int64)))
            score = np.concatenate((score, pdf["score"].to_numpy(np.float64, na_value=np.nan)))
            order = np.lexsort((number, group))
            group = group[order]
            left = np.searchsorted(group, group, "right") - np.arange(len(group))     # rows of the study from here on
            group, order = group[left <= self.w], order[left <= self.w]
            study, completed, number, score = names[group], count[group], number[order], score[order]
            touched.append(names[np.unique(new)])
        if touched:
            self.last.put((study, completed, number, score))
            (group, at), _ = _numbered(study, np.concatenate(touched))
            at = np.unique(at)
            first, end = np.searchsorted(group, at), np.searchsorted(group, at, "right")
            yield pd.DataFrame({"study": study[first], "slot": np.int64(key[1]), "completed": completed[first],
                                "numbers": [number[a:b] for a, b in zip(first, end)], "scores": [score[a:b] for a, b in zip(first, end)]})

    def close(self):
        pass


def _label(w: int, eps: float):
    """(improvement, trend) of ``window``, the last ``w`` (number, score); scores that
    are null do not count, as in the batch operator's averages."""
    def mean(first, n):
        have = F.filter(F.transform(F.slice("window", first, n), lambda x: x["score"]), lambda s: s.isNotNull())
        return F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, s: a + s), F.size(have))
    enough = (F.col("completed") >= w) & (F.size("window") >= w)
    imp = F.when(enough, mean(1, w // 2) - mean(w // 2 + 1, w - w // 2))
    label = (F.when(F.col("improvement").isNull(), "insufficient_data").when(F.col("improvement") > eps, "improving")
             .when(F.col("improvement") < -eps, "degrading").otherwise("stable"))
    return imp, label


def two_level_trend(trials_stream: DataFrame, w: int = TREND_WINDOW, eps: float = TREND_EPS, slots: int = SLOTS,
                    buckets: int = BUCKETS) -> DataFrame:
    """Live trend label per study (update mode): the slots keep their last
    ``w`` trials, a streaming aggregate keeps the newest state of each slot of a
    study (the one with the most completed trials).  Arrival order does not
    change the label, a trial sent again does not count."""
    s = scored(trials_stream).select("study", F.col("trial_number").cast("long").alias("trial_number"), "score",
                                     F.col("state").eqNullSafe("COMPLETE").alias("done"))
    parts = _keyed(s, ["trial_number", "score", "done"], slots, buckets).transformWithStateInPandas(SlotWindow(w), _SLOT_OUT, "Update", "None")
    part = F.struct("completed", F.arrays_zip("numbers", "scores").alias("last"))
    names = [f"_s{i}" for i in range(slots)]
    newest = parts.groupBy("study").agg(*[F.max_by(part, F.when(F.col("slot") == i, F.col("completed"))).alias(n) for i, n in enumerate(names)])
    trials = F.flatten(F.array(*[F.coalesce(F.col(f"{n}.last"), F.expr("array()").cast("array<struct<numbers:bigint,scores:double>>")) for n in names]))
    trials = F.transform(trials, lambda x: F.struct(x["numbers"].alias("number"), F.when(~F.isnan(x["scores"]), x["scores"]).alias("score")))
    completed = sum((F.coalesce(F.col(f"{n}.completed"), F.lit(0)) for n in names), F.lit(0)).cast("long")
    t = newest.select("study", completed.alias("completed"), F.array_sort(trials).alias("_all"))
    t = t.select("study", "completed", F.slice("_all", F.greatest(F.size("_all") - w, F.lit(0)) + 1, w).alias("window"))
    imp, label = _label(w, eps)
    t = t.where(F.size("window") > 0).withColumn("improvement", imp).withColumn("trend", label)
    symbol = F.create_map(*[F.lit(x) for kv in TREND_SYMBOLS.items() for x in kv])
    return t.select("study", "completed", F.element_at("window", -1)["number"].alias("last_trial"), "improvement", "trend",
                    symbol[F.col("trend")].alias("symbol"))
