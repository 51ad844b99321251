"""Study dashboard: one row per study with everything the live display and
the completion summary show, computed from the trial log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.fmt import quality_bar
from tessera.functions.numeric import grade, rate_pct
from tessera.operators import trials as TR


def dashboard(trials: DataFrame, n_trials: int) -> DataFrame:
    """Per study: completed / remaining / status, best trial, its grade and
    quality bar, latest trend and recent averages, run time and ETA."""
    last = F.struct(F.col("seq"), F.col("trial_number"))
    best = (TR.running_best(trials).groupBy("study")
            .agg(F.max_by(F.struct("best_trial", "best_divergence", "best_hits"), last).alias("b"))
            .select("study", "b.*"))
    tr = (TR.trend(trials).groupBy("study")
          .agg(F.max_by(F.struct("trend", "symbol"), last).alias("t")).select("study", "t.*"))
    rec = (TR.recent_avg(trials).groupBy("study")
           .agg(F.max_by(F.struct("avg_divergence", "avg_rate_pct"), last).alias("r")).select("study", "r.*"))
    eta = (TR.eta(trials, n_trials).groupBy("study")
           .agg(F.max_by(F.struct("pct", "remaining_s"), last).alias("e")).select("study", "e.*"))
    out = (TR.resume_plan(trials, n_trials).join(TR.run_summary(trials), "study", "left")
           .join(best, "study", "left").join(tr, "study", "left").join(rec, "study", "left")
           .join(eta, "study", "left"))
    total = trials.groupBy("study").agg(F.max("total").alias("_total"))
    out = out.join(total, "study", "left")
    r = rate_pct("best_hits", "_total")
    return out.withColumn("grade", grade("best_divergence", r)) \
              .withColumn("quality", quality_bar(F.coalesce("best_divergence", F.lit(1.0)))) \
              .drop("_total")
