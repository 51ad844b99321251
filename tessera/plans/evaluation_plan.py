"""Candidate-vs-base evaluation of stored outputs (no model in the loop)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import DEFAULT_MARKERS, MARKER_HEAD_TOKENS
from tessera.operators.evaluate import flag_responses, hit_rate, kl_divergence, relative_score


def evaluate(responses: DataFrame, logprobs: DataFrame, base_model: str = "base",
             markers=DEFAULT_MARKERS, head: int | None = MARKER_HEAD_TOKENS,
             kl_scale: float = 1.0) -> DataFrame:
    """Per model: hits / total / rate over ``responses`` (first ``head``
    tokens), KL(base || model) over ``logprobs`` (base 0 by definition), and
    the relative score (kl / scale, hits / base hits)."""
    hr = hit_rate(flag_responses(responses, markers, head=head), ["model_id"])
    kl = kl_divergence(logprobs, base_model)
    m = (hr.join(kl.select("model_id", "kl"), "model_id", "left")
         .withColumn("kl", F.when(F.col("model_id") == base_model, F.lit(0.0)).otherwise(F.col("kl"))))
    return m.join(relative_score(m, base_model, kl_scale), "model_id", "left")
