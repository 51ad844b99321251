"""Sinks: split datasets, the trial log, evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.fmt import flatten_params
from tessera.operators.index import join_null_safe
from tessera.schemas import TRIALS


LOG_FOLDERS = 16


def write_examples(examples: DataFrame, path: str, fmt: str = "parquet",
                   mode: str = "overwrite") -> None:
    """Hand over train and validation sets as one folder per split
    (snk_split_dataset)."""
    examples.write.mode(mode).partitionBy("split").format(fmt).save(path)


def append_trials(trials: DataFrame, path: str) -> None:
    """Append completed trials in ``LOG_FOLDERS`` folders by hash of the study
    (snk_trial_log), so files do not grow with the number of studies.  A
    failed task leaves no partial file (Spark's commit protocol), so an
    interrupted trial leaves no row."""
    n = LOG_FOLDERS
    (trials.withColumn("bucket", F.pmod(F.hash("study"), F.lit(n)))
     .write.mode("append").partitionBy("bucket").parquet(path))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Read the trial log; re-appended trials are de-duplicated on
    (study, trial_number), keeping the latest finish."""
    t = spark.read.schema(TRIALS).parquet(path)
    return (t.groupBy("study", "trial_number")
            .agg(F.max_by(F.struct(*[c for c in t.columns if c not in ("study", "trial_number")]),
                          "finished_at").alias("_r"))
            .select("study", "trial_number", "_r.*"))


def eval_report(best: DataFrame, base_hits: DataFrame | None = None, total_col: str = "total",
                digits: int = 2, kl_digits: int = 2, study: str = "study") -> DataFrame:
    """One Markdown report per study (snk_report): a parameter table of the
    chosen trial and a metric table of candidate vs base (base divergence is
    0 by definition).  ``best``: one trial row per study (trials schema).
    ``base_hits``: optional (study, base_hits) rows."""
    p = flatten_params(best, keys=(study, "trial_number"), digits=digits)
    rows = (p.groupBy(study).agg(F.array_sort(F.collect_list(
        F.format_string("| **%s** | %s |", "param", "value"))).alias("_rows")))
    b = best
    if base_hits is not None:
        b = join_null_safe(b, base_hits, study, "left")
    else:
        b = b.withColumn("base_hits", F.lit(None).cast("int"))
    metrics = b.select(study, F.concat_ws(
        "\n",
        F.lit("| Metric | This model | Original model |"),
        F.lit("| :----- | :--------: | :------------: |"),
        F.format_string("| **KL divergence** | %." + str(kl_digits) + "f | 0 *(by definition)* |", "divergence"),
        F.format_string("| **Hits** | %d/%d | %s/%d |", "hits", total_col,
                        F.coalesce(F.col("base_hits").cast("string"), F.lit("?")), total_col)
    ).alias("_metrics"))
    return (join_null_safe(rows, metrics, study).select(study, F.concat_ws(
        "\n", F.lit("## Parameters"), F.lit(""), F.lit("| Parameter | Value |"),
        F.lit("| :-------- | :---: |"), F.array_join("_rows", "\n"), F.lit(""),
        F.lit("## Performance"), F.lit(""), F.col("_metrics")).alias("markdown")))
