"""End-to-end corpus preparation: folder or table -> training rows -> split.

One lazy plan ``read -> segments -> tokens -> chunks -> index -> examples ->
split -> write``; the only shuffles are the global index (narrow keys) and
its join back.  Counts are observed during the write (no second pass).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, MIN_TOKENS, chunk_tokens, with_tokens
from tessera.operators.examples import TEMPLATES, to_examples
from tessera.operators.split import SPLIT_SEED, TRAIN_FRACTION, split_train_val
from tessera.sources.corpus import DEFAULT_EXTS, pick_text_column, read_corpus, to_segments
from tessera.session import materialize
from tessera.sources.sinks import write_examples

ORDER = ["doc_id", "segment_no", "chunk_no"]


def load_source(spark: SparkSession, source, exts=DEFAULT_EXTS, text_columns=None) -> DataFrame:
    """A DataFrame (text column picked by name), or a file / folder path.

    Single-file mode follows the strict rules: an unsupported suffix or an
    invalid UTF-8 file raises; folder mode skips bad files.  Documents are
    keyed by their path (``doc_id`` = path) so the order key is total.
    """
    if isinstance(source, DataFrame):
        keep = [c for c in ("doc_id",) if c in source.columns]
        if not keep:
            source = source.withColumn("doc_id", F.monotonically_increasing_id())
            keep = ["doc_id"]
        kw = {"candidates": text_columns} if text_columns else {}
        return pick_text_column(source, keep=keep, **kw)
    path = str(source)
    single = os.path.splitext(path)[1] != "" and not path.endswith("/")
    if single and not path.lower().endswith(tuple(e.lower() for e in exts)):
        raise ValueError(f"unsupported file type: {os.path.splitext(path)[1]}")
    docs, _rejects = read_corpus(spark, path, exts, on_error="raise" if single else "skip")
    return docs.select(F.col("path").alias("doc_id"), "text")


def build_examples(docs: DataFrame, sep: str | None = "\n\n", size: int = CHUNK_SIZE,
                   overlap: int = CHUNK_OVERLAP, min_n: int = MIN_TOKENS, templates=TEMPLATES,
                   frac: float = TRAIN_FRACTION, seed: int = SPLIT_SEED, exact: bool = False,
                   tokenizer=None, materialize_chunks: bool = True):
    """docs(doc_id, text) -> (segments, chunks, examples with split).

    Chunks are written once to the shared checkpoint folder (default), so the
    global index samples and numbers only their key columns and tokenisation
    runs a single time."""
    if sep is None:
        from tessera.functions.text import strip_ws
        segs = docs.select("doc_id", F.lit(0).alias("segment_no"), strip_ws("text").alias("text"))
    else:
        segs = to_segments(docs, sep)
    chunks = chunk_tokens(with_tokens(segs, tokenizer=tokenizer), size, overlap,
                          keep=["doc_id", "segment_no"], min_n=min_n)
    if materialize_chunks:
        chunks = materialize(chunks, "chunks")
    examples = split_train_val(to_examples(chunks, ORDER, templates, keep=ORDER), "example_id",
                               frac, seed, exact)
    return segs, chunks, examples


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when ``df`` is empty (a one-row probe, not a count)."""
    if df.limit(1).count() == 0:
        raise ValueError(f"no usable {what}")
    return df


def build_training_set(spark: SparkSession, source, out_path: str, fmt: str = "parquet", **kw) -> dict:
    """Folder / file / table -> train and validation folders under
    ``out_path``; returns the observed counts."""
    from pyspark.sql import Observation
    docs = load_source(spark, source)
    segs, chunks, examples = build_examples(docs, **kw)
    require_rows(segs, "text segments")
    require_rows(chunks, "chunks (every segment is under the token minimum)")
    obs = Observation("ingest")
    observed = examples.observe(obs, F.count(F.lit(1)).alias("examples"),
                                F.count_if(F.col("split") == "train").alias("train"),
                                F.count_if(F.col("split") == "validation").alias("validation"))
    write_examples(observed, out_path, fmt)
    return dict(obs.get)
