"""Cohort centroids and centroid contrast of labelled vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import l2_norm, l2_normalize, sub_arrays


def _cols(c):
    return [c] if isinstance(c, str) else list(c)


def centroids(vectors: DataFrame, by=("cohort", "layer"), vec_col: str = "vec",
              method: str = "explode") -> DataFrame:
    """Element-wise mean vector per group (agg_centroid), computed in double.

    method='explode': posexplode -> partial avg per (group, position) ->
    array re-assembled per group.  The shuffle carries at most
    partitions x groups x dims partial rows; the re-assembly collects
    exactly ``dim`` values per group (bounded by the vector width).
    method='summarizer': ``ml.stat.Summarizer`` mean over a dense vector,
    no row multiplication (better for very wide vectors).
    """
    g = _cols(by)
    if method == "summarizer":
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer
        v = vectors.select(*g, array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("_v"))
        return (v.groupBy(*g).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n"))
                .select(*g, vector_to_array("_m").alias("centroid"), "n"))
    if method != "explode":
        raise ValueError("method must be 'explode' or 'summarizer'")
    ex = vectors.select(*g, F.posexplode(vec_col).alias("pos", "x"))
    per_pos = ex.groupBy(*g, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"),
                                        F.count(F.lit(1)).alias("n"))
    return (per_pos.groupBy(*g)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_pm"), F.max("n").alias("n"))
            .select(*g, F.transform("_pm", lambda s: s["m"]).alias("centroid"), "n"))


def centroid_contrast(vectors: DataFrame, a: str, b: str, cohort_col: str = "cohort",
                      layer_col: str = "layer", vec_col: str = "vec",
                      method: str = "explode") -> DataFrame:
    """Per layer: unit(mean(b) - mean(a)) and the raw norm of the difference
    (agg_centroid_contrast).  Equal means give a zero vector and norm 0;
    layers missing either cohort are left out.

    method='explode': one partial aggregation per (layer, position) with
    cohort-conditional means gives the difference directly - no second
    centroid pass and no join; the per-layer re-assembly collects ``dim``
    values.  method='summarizer': centroids per cohort, then a join of the
    two small centroid tables.
    """
    v = vectors.where(F.col(cohort_col).isin(a, b))
    if method == "explode":
        ex = v.select(layer_col, cohort_col, F.posexplode(vec_col).alias("pos", "x"))
        is_a, is_b = F.col(cohort_col) == a, F.col(cohort_col) == b
        x = F.col("x").cast("double")
        per_pos = (ex.groupBy(layer_col, "pos")
                   .agg((F.avg(F.when(is_b, x)) - F.avg(F.when(is_a, x))).alias("d"),
                        F.count_if(is_a).alias("na"), F.count_if(is_b).alias("nb"))
                   .where((F.col("na") > 0) & (F.col("nb") > 0)))
        d = (per_pos.groupBy(layer_col).agg(F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("_pd"))
             .select(layer_col, F.transform("_pd", lambda s: s["d"]).alias("_d")))
    else:
        c = centroids(v, (cohort_col, layer_col), vec_col, method)
        ca = c.where(F.col(cohort_col) == a).select(layer_col, F.col("centroid").alias("_a"))
        cb = c.where(F.col(cohort_col) == b).select(layer_col, F.col("centroid").alias("_b"))
        d = ca.join(cb, layer_col).select(layer_col, sub_arrays("_b", "_a").alias("_d"))
    return d.select(layer_col, l2_normalize("_d").alias("direction"), l2_norm("_d").alias("norm"))
