"""Experiment-log (trial) analytics: completed filter, running best, trend,
recent averages, ETA, plateau, top trials, summaries, catalog, resume plan.

Ordered per-study computations use the bucketed, skew-safe helpers of
:mod:`tessera.operators.index`: a study holding a third of all trials is
spread over many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fmt import TREND_SYMBOLS, fmt_duration
from tessera.functions.numeric import composite, rate_pct
from tessera.operators import index as ix

# --- fixed values (must equal the reference for equal results) -------------
TREND_WINDOW = 10
TREND_EPS = 0.05
RECENT_N = 5
TOP_K = 5
PLATEAU_STABLE = 30
PLATEAU_NO_BEST = 50
# ---------------------------------------------------------------------------
BUCKET = 4096
KEY = ["study"]


def _dur_s(a, b):
    """Seconds between two timestamps (exact micros, time-zone free)."""
    return F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)).cast("double") / 1e6


def completed(trials: DataFrame) -> DataFrame:
    """Keep state = 'COMPLETE' (flt_completed); pushed to the Parquet scan."""
    return trials.where(F.col("state") == "COMPLETE")


def scored(trials: DataFrame) -> DataFrame:
    return (trials.withColumn("rate_pct", rate_pct("hits", "total"))
            .withColumn("score", composite("divergence", "rate_pct")))


def sequenced(trials: DataFrame, study=KEY, bucket_size: int = BUCKET) -> DataFrame:
    """Completed, scored trials with ``seq`` = 1-based position among the
    study's completed trials by trial_number.

    trial_number is a unique integer per study, so the position is a
    running count of completed trials: a bucketed cumulative sum (windows per
    (study, bucket) plus a carry) - no sort of a whole study in one task and
    no second range-partitioned index.
    """
    s = scored(trials).withColumn("_done", (F.col("state") == "COMPLETE").cast("long"))
    s = ix.cumulative_sum(s, study, "trial_number", "_done", "seq", bucket_size)
    return s.where(F.col("state") == "COMPLETE").drop("_done").withColumn("seq", F.col("seq").cast("long"))


def _with_best(trials: DataFrame, study, bucket_size: int) -> DataFrame:
    """Completed trials with ``seq`` and ``_best`` (s, t, d, h), in one pass; a
    trial without a score counts but is never best."""
    s = scored(trials)
    done = F.col("state") == "COMPLETE"
    best = F.when(done & F.col("score").isNotNull(), F.struct(F.col("score").alias("s"), F.col("trial_number").alias("t"),
                                 F.col("divergence").alias("d"), F.col("hits").alias("h")))
    r = ix.cumulative(s, study, "trial_number",
                      [("seq", "sum", done.cast("long")), ("_best", "min", best)], bucket_size)
    return r.where(done)


def running_best(trials: DataFrame, study=KEY, bucket_size: int = BUCKET) -> DataFrame:
    """After each completed trial, the best trial so far by composite score;
    strict '<' so the earliest trial wins ties (win_running_best).

    One bucketed pass over trial_number computes both the position among
    completed trials (running count) and the running argmin.
    """
    r = _with_best(trials, study, bucket_size)
    return r.select(
        *study, "trial_number", F.col("seq").cast("long").alias("seq"), "divergence", "hits", "score",
        F.col("_best.t").alias("best_trial"), F.col("_best.d").alias("best_divergence"),
        F.col("_best.h").alias("best_hits"), F.col("_best.s").alias("best_score"))


def _with_trend(s: DataFrame, w: int, eps: float, study, bucket_size: int) -> DataFrame:
    """``improvement`` and ``trend`` added to sequenced trials."""
    s = ix.with_halo(s, "seq", w, bucket_size, study)
    h1 = w // 2
    first = ix.sliding_frame(study, "seq", -(w - 1), -(w - h1))
    second = ix.sliding_frame(study, "seq", -(w - h1) + 1, 0)
    d = F.avg("score").over(first) - F.avg("score").over(second)
    t = s.withColumn("improvement", F.when(F.col("seq") >= w, d))
    label = (F.when(F.col("improvement").isNull(), F.lit("insufficient_data"))
             .when(F.col("improvement") > eps, F.lit("improving"))
             .when(F.col("improvement") < -eps, F.lit("degrading"))
             .otherwise(F.lit("stable")))
    return ix.drop_halo(t.withColumn("trend", label))


def trend(trials: DataFrame, w: int = TREND_WINDOW, eps: float = TREND_EPS,
          study=KEY, bucket_size: int = BUCKET) -> DataFrame:
    """Trend label after each completed trial over the last ``w`` (win_trend):
    d = avg(first w//2) - avg(rest); > eps improving, < -eps degrading, else
    stable; fewer than w trials -> insufficient_data."""
    t = _with_trend(sequenced(trials, study, bucket_size), w, eps, study, bucket_size)
    sym = F.create_map(*[x for k, v in TREND_SYMBOLS.items() for x in (F.lit(k), F.lit(v))])
    return t.select(*study, "trial_number", "seq", "score", "improvement", "trend",
                    sym[F.col("trend")].alias("symbol"))


def recent_avg(trials: DataFrame, n: int = RECENT_N, study=KEY,
               bucket_size: int = BUCKET) -> DataFrame:
    """Mean divergence and rate % of the last ``n`` completed trials; NULL
    under ``n`` (win_recent_avg)."""
    s = ix.with_halo(sequenced(trials, study, bucket_size), "seq", n, bucket_size, study)
    fr = ix.sliding_frame(study, "seq", -(n - 1), 0)
    r = (s.withColumn("avg_divergence", F.when(F.col("seq") >= n, F.avg("divergence").over(fr)))
         .withColumn("avg_rate_pct", F.when(F.col("seq") >= n, F.avg("rate_pct").over(fr))))
    return ix.drop_halo(r).select(*study, "trial_number", "seq", "avg_divergence", "avg_rate_pct")


def eta(trials: DataFrame, total_trials: int, study=KEY) -> DataFrame:
    """Progress after each completed trial (win_eta): pct = i / total * 100,
    remaining = elapsed / i * (total - i), elapsed since the study's first
    start.  The per-study start is a partial aggregate joined back."""
    s = sequenced(trials, study)
    start = trials.groupBy(*study).agg(F.min("started_at").alias("_t0"))
    r = ix.join_null_safe(s, start, study).withColumn("elapsed_s", _dur_s("_t0", "finished_at"))
    return r.select(*study, "trial_number", "seq",
                    (F.col("seq") / F.lit(float(total_trials)) * 100).alias("pct"),
                    "elapsed_s",
                    (F.col("elapsed_s") / F.col("seq") * (F.lit(total_trials) - F.col("seq"))).alias("remaining_s"))


def plateau(trials: DataFrame, stable_n: int = PLATEAU_STABLE, no_best_n: int = PLATEAU_NO_BEST,
            w: int = TREND_WINDOW, eps: float = TREND_EPS, study=KEY,
            bucket_size: int = BUCKET) -> DataFrame:
    """Documented stop rules (win_plateau): trend stable for ``stable_n``+
    consecutive trials, or no new best for ``no_best_n``+ trials.  Island
    lengths come from running maxima (gaps-and-islands without a per-study
    window).  One frame carries sequence, best and trend: nothing is joined."""
    best = _with_best(trials, study, bucket_size).select(
        *study, "trial_number", F.col("seq").cast("long").alias("seq"), "score", F.col("_best.t").alias("best_trial"))
    j = _with_trend(best, w, eps, study, bucket_size)
    last_unstable = F.when(F.col("trend") != "stable", F.col("seq")).otherwise(F.lit(0))
    # seq of the current best trial = last seq where best_trial == trial_number
    newbest = F.when(F.col("best_trial") == F.col("trial_number"), F.col("seq")).otherwise(F.lit(0))
    j = ix.cumulative(j, study, "seq", [("_lu", "max", last_unstable), ("_lb", "max", newbest)], bucket_size)
    return j.select(*study, "trial_number", "seq", "trend",
                    (F.col("seq") - F.col("_lu")).alias("stable_run"),
                    (F.col("seq") - F.col("_lb")).alias("since_best"),
                    ((F.col("seq") - F.col("_lu") >= stable_n) |
                     (F.col("seq") - F.col("_lb") >= no_best_n)).alias("stop"))


def top_trials(trials: DataFrame, k: int = TOP_K, study=KEY, min_trials: int = TOP_K) -> DataFrame:
    """Top ``k`` completed trials per study by composite score, earlier first
    on ties, shown only with >= ``min_trials`` trials; first is starred; a trial
    without a score is not ranked (top_trials).  ``row_number() <= k`` plans as a partial per-partition
    group limit before the shuffle, so a hot study sends only k rows per
    partition.  The eligibility semi join runs after the limit, on at most
    k rows per study, so it cannot impose a study-only layout first."""
    s = scored(completed(trials))
    eligible = (s.groupBy(*study).agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") >= min_trials).select(*study))
    w = Window.partitionBy(*study).orderBy("score", "trial_number")
    r = s.where("score is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    r = ix.join_null_safe(r, eligible, study, "left_semi")
    return r.select(*study, "rank", "trial_number", "divergence", "hits", "score",
                    (F.col("rank") == 1).alias("starred"))


def run_summary(trials: DataFrame, study=KEY) -> DataFrame:
    """Trial count, total time, mean per trial (0 if none) (agg_run_summary)."""
    c = completed(trials)
    agg = c.groupBy(*study).agg(F.count(F.lit(1)).alias("n_trials"),
                                F.min("started_at").alias("_t0"), F.max("finished_at").alias("_t1"))
    tot = _dur_s("_t0", "_t1")
    return agg.select(*study, "n_trials", tot.alias("total_s"),
                      F.coalesce(F.try_divide(tot, F.col("n_trials").cast("double")), F.lit(0.0)).alias("mean_s"),
                      fmt_duration(tot, "trunc").alias("total_fmt"),
                      fmt_duration(F.coalesce(F.try_divide(tot, F.col("n_trials").cast("double")), F.lit(0.0)),
                                   "trunc").alias("mean_fmt"))


def study_catalog(trials: DataFrame, study=KEY, with_size: bool = False) -> DataFrame:
    """Per study: completed trials, all trials and last modification
    (agg_study_catalog).  With ``with_size`` (a file-backed trial log) the
    bytes it takes in the files that hold it, from ``_metadata``."""
    cols = [F.count_if(F.col("state") == "COMPLETE").alias("completed"),
            F.count(F.lit(1)).alias("trials"), F.max("finished_at").alias("last_finished")]
    if not with_size:
        return trials.groupBy(*study).agg(*cols)
    t = trials.select("*", F.col("_metadata.file_path").alias("_fp"),
                      F.col("_metadata.file_size").alias("_fs"))
    # a file may hold several studies: its bytes are shared out by rows, to whole
    # bytes that add up to the file (one summary row per file and study)
    files = t.groupBy(*study, "_fp").agg(F.max("_fs").alias("_fs"), F.count(F.lit(1)).alias("_n"))
    per_file = Window.partitionBy("_fp")
    upto = F.sum("_n").over(per_file.orderBy(*study).rowsBetween(Window.unboundedPreceding, 0))
    files = files.withColumn("_to", upto).withColumn("_all", F.sum("_n").over(per_file))
    share = F.expr("_fs * _to div _all") - F.expr("_fs * (_to - _n) div _all")
    size = files.groupBy(*study).agg(F.sum(share).alias("size_bytes"))
    return ix.join_null_safe(t.groupBy(*study).agg(*cols), size, study)


def resume_plan(trials: DataFrame, n_trials: int, study=KEY) -> DataFrame:
    """completed, remaining = max(n - completed, 0), status new / partial /
    done (agg_resume_plan).  A study with only failed trials is 'new'."""
    a = trials.groupBy(*study).agg(F.count_if(F.col("state") == "COMPLETE").alias("completed"))
    return a.select(*study, "completed",
                    F.greatest(F.lit(n_trials) - F.col("completed"), F.lit(0)).alias("remaining"),
                    F.when(F.col("completed") == 0, F.lit("new"))
                    .when(F.col("completed") >= n_trials, F.lit("done"))
                    .otherwise(F.lit("partial")).alias("status"))
