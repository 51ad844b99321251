"""Trials by event time (``finished_at``): watermark, tumbling windows, late rows.

The watermark is the largest end of the trials seen so far less ``delay``.  A
trial sent again is dropped.  A new trial that ends behind the watermark is
late: the batch log (an append sink without these operators) keeps it, the
operators here leave it out.  So their state holds only what may still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.trials import scored

EVENT = "_event_time"


def on_time(trials_stream: DataFrame, delay: str, ts_col: str = "finished_at") -> DataFrame:
    """Each (study, trial_number) once, without late ones and without rows that
    have no event time.  The state forgets a trial when the watermark has passed it."""
    return _on_time(trials_stream, delay, ts_col).drop(EVENT)


def _on_time(trials_stream: DataFrame, delay: str, ts_col: str) -> DataFrame:
    # a watermark needs a timestamp with time zone: the session's, UTC by default
    rows = trials_stream.withColumn(EVENT, F.col(ts_col).cast("timestamp")).where(F.col(EVENT).isNotNull())
    return rows.withWatermark(EVENT, delay).dropDuplicatesWithinWatermark(["study", "trial_number"])


def windowed_trials(trials_stream: DataFrame, window: str, delay: str, ts_col: str = "finished_at") -> DataFrame:
    """Per study and tumbling window: trials, completed ones, their mean and best
    score (update mode; a window is final once the watermark has passed its end)."""
    s = scored(_on_time(trials_stream, delay, ts_col))
    done = F.col("state").eqNullSafe("COMPLETE")
    score = F.when(done, F.col("score"))
    w = (s.groupBy("study", F.window(EVENT, window).alias("window"))
         .agg(F.count(F.lit(1)).alias("trials"), F.count_if(done).alias("completed"),
              F.avg(score).alias("mean_score"), F.min(score).alias("best_score")))
    return w.withColumn("window", F.col("window").cast("struct<start:timestamp_ntz,end:timestamp_ntz>"))


def late_trials(log: DataFrame, accepted: DataFrame) -> DataFrame:
    """Trials of the batch log that came too late for the event-time operators:
    not among those that ``on_time`` let through (anti join on the trial's key)."""
    return log.join(accepted.select("study", "trial_number"), ["study", "trial_number"], "left_anti")
