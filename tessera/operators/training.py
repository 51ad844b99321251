"""Training-side logs: batch-size sweep, throughput choice, perplexity,
checkpoint retention, step plans and ingest statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import step_plan

# --- fixed values (must equal the reference for equal results) -------------
BATCH_SIZE = 4
GRAD_ACCUM = 8
EPOCHS = 3
WARMUP_RATIO = 0.1
KEEP_CHECKPOINTS = 3
# ---------------------------------------------------------------------------


def usable_sweep(bench_log: DataFrame, by=("config",)) -> DataFrame:
    """Sweep rows before the first failure per config (win_first_failure).
    A failure at the smallest size is fatal (the query raises).  The first
    failure is a partial aggregate joined back (one row per config)."""
    by = list(by)
    first = bench_log.groupBy(*by).agg(
        F.min(F.when(~F.col("ok"), F.col("batch_size"))).alias("_ff"),
        F.min("batch_size").alias("_smallest"))
    j = bench_log.join(first, by)
    j = j.withColumn("_chk", F.when(F.col("_ff") == F.col("_smallest"), F.raise_error(
        F.concat(F.lit("batch size sweep failed at the smallest size for "),
                 F.concat_ws(",", *[F.col(c).cast("string") for c in by])))))
    return (j.where(F.col("_chk").isNull() & (F.col("_ff").isNull() | (F.col("batch_size") < F.col("_ff"))))
            .drop("_ff", "_smallest", "_chk"))


def best_batch(bench_log: DataFrame, by=("config",)) -> DataFrame:
    """tokens / elapsed per batch size; max wins, ties keep the smallest
    size (agg_throughput).  Over the usable part of the sweep."""
    by = list(by)
    u = usable_sweep(bench_log, by).withColumn("tps", F.col("tokens") / F.col("elapsed_s"))
    return (u.groupBy(*by).agg(
        F.max_by(F.struct("batch_size", "tps"), F.struct(F.col("tps"), -F.col("batch_size"))).alias("_b"))
        .select(*by, F.col("_b.batch_size").alias("batch_size"), F.col("_b.tps").alias("tps")))


def perplexity(steps: DataFrame, by=("run",)) -> DataFrame:
    """exp(eval_loss) of the last evaluation per run (agg_perplexity)."""
    by = list(by)
    last = steps.where(F.col("eval_loss").isNotNull()).groupBy(*by).agg(
        F.max_by("eval_loss", "step").alias("eval_loss"), F.max("step").alias("step"))
    return last.select(*by, "step", "eval_loss", F.exp("eval_loss").alias("perplexity"))


def keep_checkpoints(steps: DataFrame, n: int = KEEP_CHECKPOINTS, every: int = 1,
                     by=("run",)) -> DataFrame:
    """Checkpoints every ``every`` steps; keep the ``n`` with the lowest
    eval loss, earlier step first on ties (win_checkpoint_keep).  The
    ``row_number() <= n`` filter is planned as a partial group limit."""
    by = list(by)
    c = steps.where((F.col("step") % every == 0) & F.col("eval_loss").isNotNull())
    w = Window.partitionBy(*by).orderBy("eval_loss", "step")
    return (c.withColumn("keep_rank", F.row_number().over(w)).where(F.col("keep_rank") <= n)
            .select(*by, "step", "eval_loss", "keep_rank"))


def split_step_plan(examples: DataFrame, batch_size: int = BATCH_SIZE, accum: int = GRAD_ACCUM,
                    epochs: int = EPOCHS, warmup_ratio: float = WARMUP_RATIO,
                    split_col: str = "split") -> DataFrame:
    """Step plan per split from the row counts (num_step_plan)."""
    counts = examples.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"))
    plan = step_plan("n_rows", batch_size, accum, epochs, warmup_ratio)
    return counts.select(split_col, "n_rows", *[v.alias(k) for k, v in plan.items()])


def ingest_stats(segments: DataFrame, chunks: DataFrame, examples: DataFrame,
                 split_col: str = "split") -> DataFrame:
    """Counts of segments, chunks, train and validation rows as (metric,
    value) rows (agg_ingest_stats); each count is a partial aggregate."""
    s = segments.agg(F.count(F.lit(1)).alias("value")).select(F.lit("segments").alias("metric"), "value")
    c = chunks.agg(F.count(F.lit(1)).alias("value")).select(F.lit("chunks").alias("metric"), "value")
    e = examples.groupBy(split_col).agg(F.count(F.lit(1)).alias("value")).select(
        F.col(split_col).alias("metric"), "value")
    return s.unionByName(c).unionByName(e)


def observe_ingest(segments: DataFrame, chunks: DataFrame):
    """Attach observed counts to the corpus plan without a second pass; the
    values are available after the first action on the returned frames."""
    o_seg, o_chk = Observation("segments"), Observation("chunks")
    return (segments.observe(o_seg, F.count(F.lit(1)).alias("segments")),
            chunks.observe(o_chk, F.count(F.lit(1)).alias("chunks")), o_seg, o_chk)


def count_while_chunking(segments: DataFrame, chunk):
    """(chunks, seen, made) with ``chunks = chunk(segments)``, both frames' rows
    counted as they pass: ``seen.get`` and ``made.get`` are there after the first
    action on ``chunks``, which is the only pass."""
    seen, made = Observation("segments"), Observation("chunks")
    counted = segments.observe(seen, F.count(F.lit(1)).alias("segments"))
    return chunk(counted).observe(made, F.count(F.lit(1)).alias("chunks")), seen, made


def observed_stats(spark, seen: dict, made: dict, examples: DataFrame, split_col: str = "split") -> DataFrame:
    """The rows of :func:`ingest_stats` from observed counts; only the examples are read."""
    known = spark.createDataFrame([("segments", seen["segments"]), ("chunks", made["chunks"])], "metric string, value long")
    return known.unionByName(examples.groupBy(F.col(split_col).alias("metric")).agg(F.count(F.lit(1)).alias("value")))
