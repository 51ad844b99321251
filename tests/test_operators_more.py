"""Operators not covered by the fixture table."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import evaluate, training, trials
from tessera.sources import bindings as B
from tessera.sources.sinks import append_trials, read_trials

SF = "/root/testdata/sf0.001"


def test_training_columns(spark):
    df = spark.createDataFrame([("a b c d",)], "t string")
    cols = text.training_columns(text.tokens("t"), 3)
    r = df.select(*[v.alias(k) for k, v in cols.items()]).first()
    assert r.input_ids == ["a", "b", "c"] and r.labels == r.input_ids


def test_marker_profile(spark):
    df = spark.createDataFrame([("m", "Sorry, I cannot"), ("m", "sorry again"), ("m", "fine")],
                               "model_id string, response string")
    got = {r.marker: r.hits for r in evaluate.marker_profile(df, by=["model_id"]).collect()}
    assert got == {"sorry": 2, "i cannot": 1}


def test_trial_log_roundtrip_and_catalog_size(spark):
    d = tempfile.mkdtemp(prefix="tessera-log-")
    t = B.trials(spark.read.parquet(f"{SF}/events.parquet"))
    append_trials(t, f"{d}/log")
    append_trials(t.where("trial_number <= 3"), f"{d}/log")  # a restarted writer re-appends
    back = read_trials(spark, f"{d}/log")
    assert back.count() == t.count()
    cat = trials.study_catalog(spark.read.parquet(f"{d}/log"), with_size=True)
    rows = cat.collect()
    assert all(r.size_bytes > 0 for r in rows)
    total = sum(os.path.getsize(os.path.join(dp, f)) for dp, _, fs in os.walk(f"{d}/log")
                for f in fs if f.endswith(".parquet"))
    assert sum(r.size_bytes for r in rows) == total


def test_observed_ingest(spark):
    segs = spark.range(10).withColumn("text", F.lit("x"))
    chunks = spark.range(25)
    s2, c2, o_seg, o_chk = training.observe_ingest(segs, chunks)
    s2.write.format("noop").mode("overwrite").save()
    c2.write.format("noop").mode("overwrite").save()
    assert o_seg.get["segments"] == 10 and o_chk.get["chunks"] == 25


def test_stream_hit_rate_windowed(spark):
    from tessera.streaming.responses_stream import stream_hit_rate
    from tessera.session import scratch_path
    src = scratch_path(spark, "resp_ts")
    spark.createDataFrame([("m", 1, "sorry", "2024-01-01 00:00:01"), ("m", 2, "ok", "2024-01-01 00:00:02"),
                           ("m", 3, "sorry", "2024-01-01 01:00:00")],
                          "model_id string, prompt_id long, response string, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    q = (stream_hit_rate(stream, window="1 hour", watermark="10 minutes").writeStream
         .outputMode("update").format("memory").queryName("hr_win").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.hits, r.total) for r in spark.sql("select * from hr_win").collect())
    assert got == [(1, 1), (1, 2)]
