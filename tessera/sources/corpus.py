"""Corpus sources: text folders, paragraph segments, text-column pick,
prompt slices and cohort unions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalize_newlines, strip_ws
from tessera.operators.index import with_global_index
from tessera.schemas import BINARY_FILE

DEFAULT_EXTS = (".txt", ".md", ".markdown")
# --- fixed values (must equal the reference for equal results) -------------
TEXT_COLUMN_CANDIDATES = ("text", "content", "document", "article", "passage")
# ---------------------------------------------------------------------------


def _ext_filter(exts):
    p = F.lower(F.col("path"))
    cond = F.lit(False)
    for e in exts:
        cond = cond | p.endswith(e.lower())
    return cond


def decode_files(files: DataFrame, exts=DEFAULT_EXTS, on_error: str = "skip"):
    """Binary file rows -> (docs, rejects).

    Keeps suffixes in ``exts`` (case-insensitive).  Strict UTF-8: invalid
    files go to ``rejects`` (on_error='skip') or fail the query
    (on_error='raise', the single-file behaviour).  CRLF -> LF.
    """
    f = files.where(_ext_filter(exts))
    raw = F.col("content").cast("string")
    valid = F.is_valid_utf8(raw)
    if on_error == "raise":
        valid = F.when(valid, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("invalid UTF-8 in "), F.col("path"))).cast("boolean"))
    elif on_error != "skip":
        raise ValueError("on_error must be 'skip' or 'raise'")
    tagged = f.select("path", "length", valid.alias("_ok"), raw.alias("_raw"))
    docs = tagged.where("_ok").select("path", "length", normalize_newlines("_raw").alias("text"))
    rejects = tagged.where(~F.col("_ok")).select("path", "length",
                                                 F.lit("invalid utf-8").alias("reason"))
    return docs, rejects


def read_corpus(spark: SparkSession, path: str, exts=DEFAULT_EXTS, on_error: str = "skip"):
    """Recursive folder (or single file) of text files -> (docs, rejects)
    (src_text_corpus).  Note: Spark's file listing skips names starting with
    '_' or '.'; pass explicit paths for such files."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(path))
    return decode_files(files, exts, on_error)


def _split_literal(col, sep: str):
    return F.split(col, "\\Q" + sep + "\\E", -1)


def to_segments(docs: DataFrame, sep: str = "\n\n", text_col: str = "text",
                keep=("doc_id",)) -> DataFrame:
    """Split on ``sep``, strip, drop empties; if none remain the whole
    content is one segment (src_paragraphs).  Output: keep..., segment_no,
    text."""
    parts = F.filter(F.transform(_split_literal(F.col(text_col), sep), strip_ws),
                     lambda p: p != "")
    segs = F.when(F.size(parts) == 0, F.array(F.col(text_col))).otherwise(parts)
    return docs.select(*keep, F.posexplode(segs).alias("segment_no", "text"))


def pick_text_column(df: DataFrame, candidates=TEXT_COLUMN_CANDIDATES,
                     keep=(), out: str = "text") -> DataFrame:
    """First present candidate column, else the first column, cast to string
    (src_text_column).  A schema check on the driver; the scan then reads
    only the chosen column."""
    names = df.columns
    chosen = next((c for c in candidates if c in names), names[0])
    return df.select(*keep, F.col(chosen).cast("string").alias(out))


def load_prompts(df: DataFrame, column: str, order_by, split_col: str | None = None,
                 split: str | None = None, limit: int | None = None) -> DataFrame:
    """One column of one split, first ``limit`` rows in ``order_by`` order
    (src_prompt_slice).  Tables are unordered, so ``order_by`` is required;
    the limit is the feature (``train[:400]``) and compiles to a top-k."""
    if order_by is None:
        raise ValueError("order_by is required: tables have no intrinsic order")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    d = df
    if split is not None:
        d = d.where(F.col(split_col) == split)
    d = d.select(*keys, F.col(column).alias("text"))
    if limit is not None:
        d = d.orderBy(*keys).limit(limit)
    return d


_SLICE = re.compile(r"^([^\[\]]+)(?:\[(-?\d+)?(%?):(-?\d+)?(%?)\])?$")


def parse_slice(spec: str):
    """``name[from:to]`` -> (name, from, to); a bound is None, a position or, as
    ``n%``, a share (percent, True).  Negative positions count from the end."""
    m = _SLICE.match(spec.strip())
    if not m:
        raise ValueError(f"not a slice: {spec!r}")
    name, a, pa, b, pb = m.groups()
    bound = lambda x, share: None if x is None else (int(x), bool(share))
    return name, bound(a, pa), bound(b, pb)


def load_slice(df: DataFrame, spec: str, column: str, order_by, split_col: str) -> DataFrame:
    """One column of the rows that ``spec`` names, such as ``train[:400]``,
    ``train[100:250]``, ``train[10%:20%]`` or ``train[-50:]`` (src_prompt_slice).

    Shares are of the split's rows, rounded to the nearest row (halves to the
    even one).  A slice from the start is a top-k; any other one numbers the
    split's rows over range partitions."""
    name, first, last = parse_slice(spec)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if first is None and (last is None or (last[0] >= 0 and not last[1])):
        return load_prompts(df, column, keys, split_col, name, None if last is None else last[0])
    rows = df.where(F.col(split_col) == name).select(*keys, F.col(column).alias("text"))
    n = rows.count()

    def place(bound, default):
        if bound is None:
            return default
        x = round(bound[0] * n / 100) if bound[1] else bound[0]
        return min(max(x + n if x < 0 else x, 0), n)
    lo, hi = place(first, 0), place(last, n)
    return with_global_index(rows, keys, "_at").where((F.col("_at") >= lo) & (F.col("_at") < hi)).drop("_at")


def cohorts(specs) -> DataFrame:
    """Union of tagged cohort frames (src_cohort_union).

    ``specs`` = iterable of (cohort, purpose, DataFrame with the prompt key and
    text).  Returns the ``prompts`` schema."""
    out = None
    for cohort, purpose, df in specs:
        tags = ("cohort", "purpose")
        t = df.select(*[c for c in df.columns if c not in tags], F.lit(cohort).alias("cohort"), F.lit(purpose).alias("purpose"))
        out = t if out is None else out.unionByName(t)
    return out


def cohort_counts(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("cohort", "purpose").agg(F.count(F.lit(1)).alias("n_prompts"))
