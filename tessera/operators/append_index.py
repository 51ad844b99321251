"""A global index that stays the same under appends (idx_global for data that
keeps arriving).

Rows are appended in segments.  A segment's rows are numbered in their order
(``with_global_index``: range partitions and offsets, no single task) from where
the segment before it ended, and written once.  What is kept about a segment is
one row, (segment, first, n); it is written after the rows and makes them count.
So an append reads the list of segments and its own rows, never those before,
and a number once given is never changed.  A segment appended again (a repeated
micro-batch) is recognised by its number and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.index import with_global_index

_LOG = "segment long, first long, n long"


def _exists(spark: SparkSession, path: str) -> bool:
    leaf = spark._jvm.org.apache.hadoop.fs.Path(path)
    return leaf.getFileSystem(spark._jsc.hadoopConfiguration()).exists(leaf)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment, first, n) of the segments that count."""
    at = f"{path}/log"
    return spark.read.schema(_LOG).parquet(f"{at}/*") if _exists(spark, at) else spark.createDataFrame([], _LOG)


def append_indexed(df: DataFrame, path: str, order_by, segment: int | None = None, idx_col: str = "idx") -> tuple[int, int]:
    """Append the rows of ``df`` in ``order_by`` order (a unique key inside the
    segment); returns (first, n) of the segment.  ``segment`` numbers the
    appends (a micro-batch's id); without it the next free number is taken."""
    spark = df.sparkSession
    log = segments(spark, path)
    if segment is not None and (again := log.where(F.col("segment") == segment).first()) is not None:
        return again["first"], again["n"]
    last = log.agg(F.max("segment").alias("s"), F.max(F.col("first") + F.col("n")).alias("next")).first()
    number = segment if segment is not None else (-1 if last["s"] is None else last["s"]) + 1
    if last["s"] is not None and number < last["s"]:
        raise ValueError(f"segment {number} comes after {last['s']}, whose numbers are given")
    first = last["next"] or 0
    rows = with_global_index(df, order_by, "_at").withColumn(idx_col, F.col("_at") + F.lit(first)).drop("_at")
    at = f"{path}/rows/segment={number}"
    rows.write.mode("overwrite").parquet(at)
    n = spark.read.parquet(at).count()
    spark.createDataFrame([(number, first, n)], _LOG).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{number}")
    return first, n


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    """All rows that count, with their number and ``segment``."""
    known = [r["segment"] for r in segments(spark, path).select("segment").collect()]
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where(F.col("segment").isin(known)).withColumn("segment", F.col("segment").cast("long"))


def append_batches(order_by, path: str, idx_col: str = "idx"):
    """``foreachBatch`` function: every micro-batch is a segment."""
    def write(batch: DataFrame, batch_id: int):
        append_indexed(batch, path, order_by, batch_id, idx_col)
    return write
