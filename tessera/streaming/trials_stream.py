"""Live trial-log operators: running best, trend, de-duplicated resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.trials import TREND_EPS, TREND_WINDOW, scored
from tessera.streaming.trial_state import SLOTS, first_rows, two_level_trend


def stream_best(trials_stream: DataFrame) -> DataFrame:
    """Per study: completed count and best completed trial so far by
    composite score, earliest on ties (str_running_best).  Update mode.
    A trial sent again is dropped, by runs of seen numbers; one without a score counts but is never best."""
    s = scored(first_rows(trials_stream.select("study", "trial_number", "state", "divergence", "hits", "total"), mode="Update"))
    done = F.col("state") == "COMPLETE"
    key = F.when(done & F.col("score").isNotNull(), F.struct("score", "trial_number"))
    val = F.struct(F.col("trial_number").alias("best_trial"), F.col("divergence").alias("best_divergence"),
                   F.col("hits").alias("best_hits"), F.col("score").alias("best_score"))
    return (s.groupBy("study").agg(F.count_if(done).alias("completed"),
                                   F.min_by(val, key).alias("_b"))
            .select("study", "completed", "_b.*"))


def stream_trend(trials_stream: DataFrame, w: int = TREND_WINDOW, eps: float = TREND_EPS, slots: int = SLOTS) -> DataFrame:
    """Live trend label per study (str_trend), in two levels of state, so a hot
    study is ``slots`` groups and no single one."""
    return two_level_trend(trials_stream, w, eps, slots)


def resume_stream(trials_stream: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Stop and restart without losing or repeating a trial (str_resume):
    each (study, trial_number) once, however late it comes.  Progress lives in
    the query's checkpointLocation; what was seen is kept as runs of numbers, so
    the state grows with the gaps and not with the trials."""
    return first_rows(trials_stream, slots)
