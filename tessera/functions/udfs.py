"""The two Python seams: batch scoring with a caller model and a caller
tokenizer.  Both are Arrow-batched (never row-at-a-time); the caller
function is built once per Python worker."""

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType


def batch_score(df: DataFrame, input_col: str, make_fn, return_type: DataType,
                batch_size: int = 64, out: str = "score",
                input_tensor_shapes=None) -> DataFrame:
    """Run a caller-supplied model over ``input_col`` in batches
    (udf_batch_score).

    ``make_fn()`` is called once per worker and returns ``fn(np.ndarray) ->
    np.ndarray`` of equal length (text, log-probabilities or vectors).
    Built on ``pyspark.ml.functions.predict_batch_udf``; array inputs need
    ``input_tensor_shapes`` (e.g. ``[[dim]]``).
    """
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_fn, return_type=return_type, batch_size=batch_size,
                            input_tensor_shapes=input_tensor_shapes)
    return df.withColumn(out, udf(F.col(input_col)))


def length_model():
    """Deterministic stub model: the character length of each input."""
    import numpy as np

    def predict(inputs):
        return np.array([len(s) for s in inputs], dtype=np.int32)
    return predict


def tokenize(df: DataFrame, text_col: str, tokenizer, out: str = "tokens",
             as_ids: bool = False) -> DataFrame:
    """Caller tokenizer as an iterator pandas UDF (udf_tokenizer).

    ``tokenizer`` is a zero-argument factory (built once per worker) whose
    result has ``encode(str) -> list``.  With ``as_ids`` the ids are kept,
    otherwise the ids are returned as strings.  Default tokenisation is the
    native whitespace split in :func:`tessera.functions.text.tokens`.
    """
    rtype = ArrayType(IntegerType()) if as_ids else ArrayType(StringType())

    @F.pandas_udf(rtype)
    def _enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer()
        for s in batches:
            if as_ids:
                yield s.map(lambda x: list(tok.encode(x)) if x is not None else None)
            else:
                yield s.map(lambda x: [str(t) for t in tok.encode(x)] if x is not None else None)

    return df.withColumn(out, _enc(F.col(text_col)))


_CHUNK = StructType([StructField("chunk_no", LongType()), StructField("start_token", LongType()),
                     StructField("n_tokens", LongType()), StructField("text", StringType())])
CHARS_AT_ONCE = 1 << 20         # of texts encoded together, of windows decoded together, of text in a batch
TEXTS_AT_ONCE = 256


def slices(column, most_rows: int = TEXTS_AT_ONCE, most_bytes: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Parts (first, rows) of a string column of an Arrow batch, of at most
    ``most_rows`` rows and ``most_bytes`` bytes, or of one larger text."""
    import pyarrow.compute as pc
    first = room = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > first and (n > room or i - first >= most_rows):
            yield first, i - first
            first = i
        if i == first:
            room = most_bytes
        room -= n
    if len(column):
        yield first, len(column) - first


def token_chunks(df: DataFrame, text_col: str, tokenizer, size: int = 1024, overlap: int = 128,
                 min_n: int = 0, keep=()) -> DataFrame:
    """Chunks of a caller tokenizer: encode, cut into windows of ``size``
    tokens that share ``overlap``, decode each window (udf_tokenizer).

    ``tokenizer`` is a zero-argument factory (built once per task) whose
    result has ``encode(str) -> list`` and ``decode(list) -> str``, or batch
    forms ``encode_batch`` / ``decode_batch``, which are preferred.  A text of
    at most ``size`` tokens keeps its own text; one under ``min_n`` tokens or
    null gives no chunk.  Returns ``keep``, chunk_no, start_token, n_tokens, text.

    Tokens are much larger than text, so a worker holds those of
    ``CHARS_AT_ONCE`` bytes of text (or of one larger text), however many rows
    a batch has, and hands chunks on as they come.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under size")
    step = size - overlap
    rows = df.select(*keep, F.col(text_col))
    n_keep = len(rows.columns) - 1
    names = [f"c{i}" for i in range(n_keep)]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, rows.schema)] + _CHUNK.fields)

    def run(batches):
        import pyarrow as pa
        tok = tokenizer()
        encode = getattr(tok, "encode_batch", None) or (lambda xs: [tok.encode(x) for x in xs])
        decode = getattr(tok, "decode_batch", None) or (lambda xs: [tok.decode(x) for x in xs])
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def chunks(part):
            """(row, chunk_no, start_token, n_tokens, text) of the texts of ``part``."""
            texts = [(i, t) for i, t in enumerate(part.to_pylist()) if t is not None]
            for (i, text), ids in zip(texts, encode([t for _, t in texts])):
                n = len(ids)
                if n < min_n:
                    continue
                if n <= size:
                    yield i, 0, 0, n, text
                    continue
                starts = range(0, n - overlap, step)
                at_once = max(CHARS_AT_ONCE // (8 * size), 1)
                for k in range(0, len(starts), at_once):
                    windows = [ids[at:at + size] for at in starts[k:k + at_once]]
                    for j, (at, w, t) in enumerate(zip(starts[k:k + at_once], windows, decode(windows)), k):
                        yield i, j, at, len(w), t

        def batch(part, found):
            row, *columns = zip(*found)
            kept = [c.take(pa.array(row, pa.int32())) for c in part.columns[:n_keep]]
            return pa.RecordBatch.from_arrays(kept + [pa.array(c, t) for c, t in zip(columns, types)], names + _CHUNK.names)

        for b in batches:
            for first, n in slices(b.column(n_keep)):
                part, found, held = b.slice(first, n), [], 0
                for chunk in chunks(part.column(n_keep)):
                    found.append(chunk)
                    held += len(chunk[-1])
                    if held >= CHARS_AT_ONCE:
                        yield batch(part, found)
                        found, held = [], 0
                if found:
                    yield batch(part, found)

    return rows.mapInArrow(run, schema).toDF(*rows.columns[:-1], *_CHUNK.names)


class WhitespaceTokenizer:
    """Reference tokenizer for tests: Python ``str.split``."""

    def encode(self, text):
        return text.split()

    def decode(self, tokens):
        return " ".join(tokens)
