"""Live marker rate over arriving responses, and arriving corpus files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import DEFAULT_MARKERS, strip_ws
from tessera.operators.chunking import chunk_tokens, min_tokens, with_tokens
from tessera.operators.evaluate import flag_responses
from tessera.functions.numeric import rate_pct
from tessera.sources.corpus import to_segments
from tessera.sources.text_files import stream_text_files


def stream_hit_rate(responses_stream: DataFrame, markers=DEFAULT_MARKERS,
                    head: int | None = None, window: str | None = None,
                    watermark: str | None = None, ts_col: str = "ts") -> DataFrame:
    """Live hit rate per model (str_hit_rate): stateless flags, then a
    streaming aggregate; optionally per event-time window with a watermark."""
    f = flag_responses(responses_stream, markers, head=head)
    keys = ["model_id"]
    if window:
        f = f.withWatermark(ts_col, watermark or window)
        keys = [F.window(ts_col, window).alias("window")] + keys
    return (f.groupBy(*keys).agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total"))
            .withColumn("rate_pct", rate_pct("hits", "total")))


def stream_corpus(spark: SparkSession, path: str, log: str, separator: str | None = None, sep: str | None = None,
                  size: int = 1024, overlap: int = 128, min_n: int = 50, rejects: bool = False) -> DataFrame:
    """Newly arrived text files become token chunks (str_corpus); the same
    stateless operators as the batch corpus plan.  ``separator`` parts the texts
    of a file, ``sep`` the segments of a text.  With ``rejects`` the stream has
    the files that could not be read instead, with the reason."""
    files = stream_text_files(spark, path, log, separator)
    if rejects:
        return files.where("reason is not null").select("path", "bytes", "reason")
    docs = files.where("reason is null").select(F.col("path").alias("doc_path"), "part", "text")
    if sep is None:
        segs = docs.select("doc_path", "part", F.lit(0).alias("segment_no"), "text")
    else:
        segs = to_segments(docs, sep, keep=("doc_path", "part"))
    toks = min_tokens(with_tokens(segs.withColumn("text", strip_ws("text"))), min_n)
    return chunk_tokens(toks, size, overlap, keep=["doc_path", "part", "segment_no"])
