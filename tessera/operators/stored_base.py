"""A base model's log-probabilities stored once by prompt, joined with many
candidates without being shuffled again (agg_kl, join_base_candidate).

The base is written in ``buckets`` files by hash of the prompt key, sorted by it.
A join on that key then reads the base as it lies; only the candidates are
shuffled, to the same number of buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import kl_term_sum
from tessera.session import scratch_path

BUCKETS = 32


def store_by_key(df: DataFrame, key: str, buckets: int = BUCKETS, name: str = "by_key") -> DataFrame:
    """``df`` written once in the shared folder, bucketed and sorted by ``key``.
    The table's entry in the catalog is only needed to write and resolve it."""
    spark = df.sparkSession
    table = f"tessera_{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")         # an external table: the files stay, and so does the resolved plan
    return out


def store_base(logprobs: DataFrame, base_model: str = "base", buckets: int = BUCKETS) -> DataFrame:
    """(prompt_id, base_lp) of the base model.  A prompt that the base answers
    twice is refused."""
    base = logprobs.where(F.col("model_id") == base_model).groupBy("prompt_id").agg(
        F.first("lp").alias("lp"), F.count(F.lit(1)).alias("n"))
    twice = F.raise_error(F.lit("the base model answers a prompt twice")).cast("array<double>")
    return store_by_key(base.select("prompt_id", F.when(F.col("n") > 1, twice).otherwise(F.col("lp")).alias("base_lp")),
                        "prompt_id", buckets, "base")


def kl_against(base: DataFrame, candidates: DataFrame, by="model_id") -> DataFrame:
    """KL(base || candidate) per candidate model: the mean over its prompts."""
    # a side under the broadcast limit would be sent whole to every task for each model that is compared
    j = candidates.hint("merge").join(base.hint("merge"), "prompt_id")
    return j.groupBy(by).agg(F.avg(kl_term_sum("base_lp", "lp")).alias("kl"), F.count(F.lit(1)).alias("n_prompts"))


def relative_against(base: DataFrame, candidates: DataFrame, hit, scale: float = 1.0, by="model_id") -> DataFrame:
    """(kl / scale, hits / base hits) per candidate model in one pass over the
    candidates (agg_relative_score).  ``hit(column)`` tells whether a row of
    log-probabilities counts as a hit; NULL when the base has none."""
    hits = base.agg(F.count_if(hit("base_lp")).cast("double").alias("base_hits"))      # one row
    j = candidates.hint("merge").join(base.hint("merge"), "prompt_id", "left")
    m = j.groupBy(by).agg(F.avg(kl_term_sum("base_lp", "lp")).alias("kl"), F.count_if(hit("lp")).cast("double").alias("hits"))
    one = hits.withColumn("_k", F.lit(1))
    return m.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k").select(
        by, (F.col("kl") / scale).alias("kl_score"), F.try_divide("hits", F.nullif("base_hits", F.lit(0.0))).alias("hit_score"))
