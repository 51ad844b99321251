"""Adaptive batch scoring: a caller's model over rows, batches halved when the
model fails, results of several kinds at once, and restart without scoring again
(udf_batch_score).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessera.operators.index import join_null_safe


def score_halving(score, rows: list, size: int):
    """Yield (result, error, size of the batch that worked) per row, in order.

    ``score(list) -> list`` of equal length.  A failing batch is tried again in
    halves, down to one row; a row that fails alone gives its error.  The size
    that worked stays for the batches that follow and grows back, doubled
    after each success, up to the size given."""
    at, now = 0, size
    while at < len(rows):
        part = rows[at:at + now]
        try:
            out = list(score(part))
            if len(out) != len(part):
                raise ValueError(f"the model gave {len(out)} results for {len(part)} rows")
        except Exception as e:  # noqa: BLE001  whatever the caller's model raises
            if len(part) > 1:
                now = max(1, len(part) // 2)
                continue
            yield None, f"{type(e).__name__}: {e}", 1
        else:
            for x in out:
                yield x, None, len(part)
            now = min(size, now * 2)
        at += len(part)


def score_rows(df: DataFrame, keys, input_col: str, make_model, out_type: StructType, batch_size: int = 64) -> DataFrame:
    """``keys``, the fields of ``out_type``, ``error`` and ``batch`` (rows scored together).

    ``make_model()`` is called once per task and gives ``score(list) -> list of
    dicts`` with the fields of ``out_type`` (text, log-probabilities, a vector...).
    A null input is passed on as None.  A row that the model fails on alone has
    null fields and the error."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if clash := {"error", "batch", *keys} & set(out_type.names) or {"error", "batch"} & set(keys):
        raise ValueError(f"names used twice: {sorted(clash)}")
    rows = df.select(*keys, F.col(input_col).alias("_input"))
    schema = StructType([*[rows.schema[k] for k in keys], *[StructField(f.name, f.dataType) for f in out_type],
                         StructField("error", StringType()), StructField("batch", IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    fields = [f.type for f in to_arrow_schema(out_type)]
    names = list(out_type.names)

    def run(batches):
        score = make_model()
        for b in batches:
            results = list(score_halving(score, b.column(len(keys)).to_pylist(), batch_size))
            columns = [pa.array([None if r is None else r.get(n) for r, _, _ in results], t) for n, t in zip(names, fields)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], *columns, pa.array([e for _, e, _ in results], pa.string()),
                                              pa.array([n for _, _, n in results], pa.int32())], schema.names)
    return rows.mapInArrow(run, schema)


def score_missing(df: DataFrame, keys, input_col: str, make_model, out_type: StructType, path: str, batch_size: int = 64,
                  retry_errors: bool = True) -> DataFrame:
    """Score the rows whose key is not yet in the results at ``path``, append
    theirs, and return all results.  After a stop only the rest is scored (an
    anti join on the key); rows that failed are tried again unless told not to."""
    from pyspark.errors import AnalysisException
    spark, keys = df.sparkSession, [keys] if isinstance(keys, str) else list(keys)
    try:
        done = spark.read.parquet(path)
    except AnalysisException:
        done = None
    todo = df
    if done is not None:
        fine = done.where("error is null") if retry_errors else done
        todo = join_null_safe(df, fine.select(*keys), keys, "left_anti")
    score_rows(todo, keys, input_col, make_model, out_type, batch_size).write.mode("append").parquet(path)
    return latest_results(spark.read.parquet(path), keys)


def latest_results(results: DataFrame, keys) -> DataFrame:
    """One row per key: a result without error before one with."""
    rest = [c for c in results.columns if c not in keys]
    best = results.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("error").isNotNull()).alias("_r"))
    return best.select(*keys, "_r.*")
