"""Token chunking: min-token filter and overlapping sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens as ws_tokens

# --- fixed values (must equal the reference for equal results) -------------
MIN_TOKENS = 50
CHUNK_SIZE = 1024
CHUNK_OVERLAP = 128
# ---------------------------------------------------------------------------


def with_tokens(df: DataFrame, text_col: str = "text", out: str = "tokens",
                tokenizer=None) -> DataFrame:
    """Add a token array.  Default: native whitespace split (JVM).  A caller
    tokenizer goes through :func:`tessera.functions.udfs.tokenize`."""
    if tokenizer is None:
        return df.withColumn(out, ws_tokens(text_col))
    from tessera.functions.udfs import tokenize
    return tokenize(df, text_col, tokenizer, out)


def min_tokens(df: DataFrame, n: int = MIN_TOKENS, tokens_col: str = "tokens") -> DataFrame:
    """Drop whole segments under ``n`` tokens (flt_min_tokens)."""
    return df.where(F.size(tokens_col) >= n)


def chunk_count(n_tokens, size: int, overlap: int):
    step = size - overlap
    n = F.col(n_tokens) if isinstance(n_tokens, str) else n_tokens
    return F.when(n <= size, F.lit(1)).otherwise(
        (F.lit(1) + F.ceil((n - size) / step)).cast("int"))


def chunk_tokens(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                 text_col: str = "text", tokens_col: str = "tokens",
                 keep=None, min_n: int | None = None) -> DataFrame:
    """Sliding windows over tokens (seq_sliding_chunks).

    n <= size: one chunk, text unchanged.  Otherwise windows start at
    0, size-overlap, ... and stop once a window reaches the end; count =
    1 + ceil((n - size) / (size - overlap)).  Multi-chunk text is the tokens
    joined by one space.  A generator done natively with posexplode; each
    input row expands independently (no shuffle).

    ``min_n`` applies flt_min_tokens inside the generator (a segment under
    ``min_n`` tokens yields no chunk), so the optimizer cannot push a
    separate filter below the tokenisation and evaluate it twice.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    step = size - overlap
    keep = [c for c in (keep if keep is not None else df.columns) if c not in (text_col, tokens_col)]
    n = F.size(tokens_col)
    starts = F.sequence(F.lit(0), chunk_count(n, size, overlap) - 1)
    if min_n is not None:
        starts = F.when(n >= min_n, starts).otherwise(F.array().cast("array<int>"))
    exploded = df.select(*keep, text_col, tokens_col, n.alias("_n"),
                         F.posexplode(starts).alias("chunk_no", "_k"))
    start = F.col("chunk_no") * step
    piece = F.slice(tokens_col, start + 1, F.lit(size))
    return exploded.select(
        *keep, "chunk_no",
        (start).cast("int").alias("start_token"),
        F.size(piece).alias("n_tokens"),
        F.when(F.col("_n") <= size, F.col(text_col)).otherwise(F.array_join(piece, " ")).alias(text_col))
