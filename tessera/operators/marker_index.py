"""Marker flags and profiles for long marker lists.

``has_marker`` tests every marker on every text.  Here each marker is known by
one gram of up to ``GRAM`` characters, its rarest one in the texts; a text's
distinct grams meet the markers in a hash join, and only a marker whose gram the
text holds is tested with ``contains``.  So the work is the grams of the texts
plus the candidates, not markers times text.  The marker table is as long as the
caller's list; it is the side that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_response

GRAM = 4


def _grams(text, sizes) -> Column:
    """Distinct substrings of the given lengths."""
    def of_size(n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(F.concat(*map(of_size, sizes)))


def marker_grams(texts: DataFrame, markers, text_col: str, gram: int = GRAM) -> DataFrame:
    """(marker, gram): of each marker the gram that the fewest texts hold.  One
    pass over the texts counts only grams that occur in some marker."""
    spark = texts.sparkSession
    ms = sorted({m.lower() for m in markers if m})
    rows = [(m, m[i:i + size]) for m in ms for size in (min(gram, len(m)),) for i in range(len(m) - size + 1)]
    of = spark.createDataFrame(rows or [], "marker string, gram string").distinct()
    sizes = sorted({len(g) for _, g in rows}) or [gram]
    found = texts.select(F.explode(_grams(F.col(text_col), sizes)).alias("gram"))
    uses = found.join(F.broadcast(of.select("gram").distinct()), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = of.join(uses, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rare.groupBy("marker").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def marker_hits(df: DataFrame, markers, keys, text_col: str = "response", gram: int = GRAM) -> DataFrame:
    """(keys..., marker): each marker that the row's normalised text holds, once.
    ``keys`` identify a row."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    text = df.select(*keys, normalize_response(F.col(text_col)).alias("_text")).where("_text is not null")
    sizes = sorted({min(gram, len(m)) for m in markers if m}) or [gram]
    known = marker_grams(text, markers, "_text", gram)
    grams = text.select(*keys, "_text", F.explode(_grams(F.col("_text"), sizes)).alias("gram"))
    held = grams.join(F.broadcast(known), "gram").where(F.contains("_text", F.col("marker"))).select(*keys, "marker")
    if any(m == "" for m in markers):                       # the empty marker is in every text
        held = held.unionByName(text.select(*keys, F.lit("").alias("marker")))
    return held


def flag_rows(df: DataFrame, markers, keys, text_col: str = "response", out: str = "hit", gram: int = GRAM) -> DataFrame:
    """``df`` with a boolean marker flag, as ``flag_responses`` gives; null where the text is null."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    hits = marker_hits(df, markers, keys, text_col, gram).select(*keys).distinct()
    hits = hits.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_hit"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = df.join(hits, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return rows.withColumn(out, F.when(F.col(text_col).isNotNull(), F.coalesce("_hit", F.lit(False)))).drop("_hit")


def indexed_profile(df: DataFrame, markers, keys, text_col: str = "response", by=(), gram: int = GRAM) -> DataFrame:
    """Which markers hit, counted per marker, as ``marker_profile`` gives."""
    keys, by = [keys] if isinstance(keys, str) else list(keys), list(by)
    rows = marker_hits(df, markers, [*keys, *[b for b in by if b not in keys]], text_col, gram)
    return rows.groupBy(*by, "marker").agg(F.count(F.lit(1)).alias("hits"))
