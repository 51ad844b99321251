"""Evaluation of stored model outputs: marker flags and rates, KL
divergence, relative scores, candidate-vs-base comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import rate_pct
from tessera.functions.text import (DEFAULT_MARKERS, has_marker, head_tokens,
                                    markers_hit, normalize_response)
from tessera.functions.vectors import kl_term_sum


def _cols(c):
    return [c] if isinstance(c, str) else list(c)


def flag_responses(df: DataFrame, markers=DEFAULT_MARKERS, text_col: str = "response",
                   head: int | None = None, out: str = "hit") -> DataFrame:
    """Add a boolean marker flag (txt_marker_flag over txt_normalize).  With
    ``head`` only the first ``head`` tokens are judged (txt_head_tokens)."""
    t = F.col(text_col)
    if head is not None:
        t = head_tokens(t, head)
    return df.withColumn(out, has_marker(normalize_response(t), markers))


def hit_rate(flags: DataFrame, by=("model_id",), flag_col: str = "hit") -> DataFrame:
    """hits, total and rate % = hits / total * 100 (0.0 when total = 0)
    (agg_hit_rate).  Partial aggregation map-side; a hot model is fine."""
    return (flags.groupBy(*_cols(by))
            .agg(F.count_if(F.col(flag_col)).alias("hits"), F.count(F.lit(1)).alias("total"))
            .withColumn("rate_pct", rate_pct("hits", "total")))


def marker_profile(df: DataFrame, markers=DEFAULT_MARKERS, text_col: str = "response",
                   by=()) -> DataFrame:
    """Which markers hit, counted per marker (txt_marker_profile)."""
    norm = normalize_response(F.col(text_col))
    return (df.select(*_cols(by), F.explode(markers_hit(norm, markers)).alias("marker"))
            .groupBy(*_cols(by), "marker").agg(F.count(F.lit(1)).alias("hits")))


def pair(prompts: DataFrame, responses: DataFrame, on="prompt_id", how: str = "inner") -> DataFrame:
    """Prompt joined to its answer(s) on the prompt key (join_prompt_response).
    ``how='left'`` keeps prompts without an answer; :func:`match_report`
    counts what an inner join leaves out."""
    return prompts.join(responses, _cols(on), how)


def match_report(left: DataFrame, right: DataFrame, on="prompt_id") -> DataFrame:
    """One row of counts over distinct keys: matched, left_only, right_only,
    left_repeated, right_repeated.  Both sides are reduced to key counts before the
    shuffle; no join."""
    on = _cols(on)
    sides = (left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
             .unionByName(right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r"))))
    k = sides.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    return k.agg(F.count_if((F.col("_l") > 0) & (F.col("_r") > 0)).alias("matched"),
                 F.count_if(F.col("_r") == 0).alias("left_only"), F.count_if(F.col("_l") == 0).alias("right_only"),
                 F.count_if(F.col("_l") > 1).alias("left_repeated"), F.count_if(F.col("_r") > 1).alias("right_repeated"))


def kl_divergence(logprobs: DataFrame, base_model: str = "base",
                  by: str = "model_id") -> DataFrame:
    """First-token KL(base || candidate) per candidate model (agg_kl):
    sum_v exp(b)*(b-c) per prompt, averaged over prompts (batchmean).

    A prompt that the base answers twice is refused.  Arrays stay packed (no
    explode).  One equi join on prompt_id shuffles each row once; AQE splits a
    hot prompt (skew join) or broadcasts a small base.  To compare a base with
    model after model, store it (:mod:`tessera.operators.stored_base`).
    """
    base = logprobs.where(F.col(by) == base_model).groupBy("prompt_id").agg(F.first("lp").alias("_b"), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.lit("kl_divergence: the base model answers a prompt twice")).cast("array<double>")
    base = base.select("prompt_id", F.when(F.col("_n") > 1, twice).otherwise(F.col("_b")).alias("_b"))
    cand = logprobs.where(F.col(by) != base_model)
    j = cand.join(base, "prompt_id")
    return (j.groupBy(by).agg(F.avg(kl_term_sum("_b", "lp")).alias("kl"),
                              F.count(F.lit(1)).alias("n_prompts")))


def relative_score(metrics: DataFrame, base_model: str = "base", scale: float = 1.0,
                   by: str = "model_id") -> DataFrame:
    """(kl / scale, hits / base_hits) per candidate (agg_relative_score).

    ``metrics`` has by, kl, hits with one row for ``base_model``.  NULL when
    the base has 0 hits (the reference would divide by zero).  The base side
    is aggregated to exactly one row before the (broadcast) join.
    """
    base = (metrics.where(F.col(by) == base_model).agg(F.max("hits").alias("base_hits"))
            .withColumn("_k", F.lit(1)))
    cand = metrics.where(F.col(by) != base_model).withColumn("_k", F.lit(1))
    return (cand.join(F.broadcast(base), "_k", "left")
            .select(by, (F.col("kl") / scale).alias("kl_score"),
                    F.try_divide(F.col("hits").cast("double"),
                                 F.when(F.col("base_hits") != 0, F.col("base_hits").cast("double")))
                    .alias("hit_score")))


def compare(responses: DataFrame, base_model: str = "base", markers=DEFAULT_MARKERS,
            head: int | None = None, on="prompt_id") -> DataFrame:
    """Candidate vs base answers on the same prompts (join_base_candidate).

    A prompt that the base answers twice is refused.  Per candidate model:
    prompts, those the base did not answer (``n_unmatched``), base hits, candidate hits, hits
    gained and lost, and candidate hits relative to base hits (NULL for 0).
    """
    f = flag_responses(responses, markers, head=head)
    on = _cols(on)
    base = f.where(F.col("model_id") == base_model).groupBy(*on).agg(
        F.max("hit").alias("_h"), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.lit("compare: the base model answers a prompt twice")).cast("boolean")
    base = base.select(*on, F.when(F.col("_n") > 1, twice).otherwise(F.col("_h")).alias("_bh"))
    cand = f.where(F.col("model_id") != base_model).select("model_id", *on, "hit")
    j = cand.join(base, on, "left")
    return (j.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_prompts"),
        F.count_if(F.col("_bh").isNull()).alias("n_unmatched"),
        F.count_if("_bh").alias("base_hits"),
        F.count_if("hit").alias("cand_hits"),
        F.count_if(F.col("hit") & ~F.col("_bh")).alias("gained"),
        F.count_if(~F.col("hit") & F.col("_bh")).alias("lost"))
        .withColumn("relative_hits", F.try_divide(
            F.col("cand_hits").cast("double"),
            F.when(F.col("base_hits") != 0, F.col("base_hits").cast("double")))))
