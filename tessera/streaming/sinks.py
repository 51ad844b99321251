"""Fault-tolerant sinks for streaming results.

Update-mode aggregates are appended per micro-batch with the batch id
(``foreachBatch`` is idempotent on replay because each batch overwrites its
own ``_batch=<id>`` folder); readers keep the latest row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_like(spark: SparkSession, settings: dict) -> SparkSession:
    """A session that shares the context, catalog cache and shared folder of
    ``spark`` and starts with its settings, then takes ``settings``: they change
    nothing for other queries."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    for k, v in settings.items():
        own.conf.set(k, str(v))
    return own


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for streams: the state store on disk, and ``state_partitions``
    (fixed in a stream's checkpoint when it first starts; the cluster's default
    parallelism, if not given)."""
    return session_like(spark, {"spark.sql.streaming.stateStore.providerClass": STATE_STORE,
                                "spark.sql.shuffle.partitions": state_partitions or spark.sparkContext.defaultParallelism})


def _run(writer, available_now: bool):
    q = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        q.awaitTermination()
    return q


def run_updates(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Run an update-mode stream into ``path`` (one folder per batch)."""
    def _write(batch: DataFrame, batch_id: int):
        (batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{path}/_batch={batch_id}"))

    w = (stream.writeStream.outputMode("update").foreachBatch(_write)
         .option("checkpointLocation", checkpoint))
    return _run(w, available_now)


def run_append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Run an append-mode stream into a Parquet folder (exactly-once file sink)."""
    w = (stream.writeStream.outputMode("append").format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint))
    return _run(w, available_now)


def read_latest(spark: SparkSession, path: str, keys) -> DataFrame:
    """Latest row per key across micro-batch folders."""
    d = spark.read.option("basePath", path).parquet(f"{path}/_batch=*")
    cols = [c for c in d.columns if c not in list(keys) + ["_batch"]]
    return (d.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("_r"))
            .select(*keys, "_r.*"))
