"""End-to-end plans: corpus folder -> training set, study dashboard,
evaluation; streaming restart parity."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_training_set_from_folder(spark):
    from tessera.plans.corpus_plan import build_training_set
    d = tempfile.mkdtemp(prefix="tessera-corpus-")
    os.makedirs(f"{d}/in/sub")
    words = " ".join(f"w{i}" for i in range(1100))
    open(f"{d}/in/a.TXT", "w").write(words + "\n\nshort para\n\n" + " ".join(["x"] * 60))
    open(f"{d}/in/sub/b.md", "w").write(" ".join(["y"] * 70))
    open(f"{d}/in/c.csv", "w").write("ignored " * 100)
    open(f"{d}/in/bad.txt", "wb").write(b"\xff\xfe" + b"bad " * 100)
    stats = build_training_set(spark, f"{d}/in", f"{d}/out")
    # a.TXT: 1100 tokens -> 2 chunks, 'short para' dropped, 60 x -> 1; b.md -> 1; csv and bad file skipped
    assert stats["examples"] == 4 and stats["train"] + stats["validation"] == 4
    back = spark.read.parquet(f"{d}/out")
    assert sorted(back.select("example_id").toPandas().example_id) == [0, 1, 2, 3]


def test_single_file_rules(spark):
    from tessera.plans.corpus_plan import build_training_set, load_source
    d = tempfile.mkdtemp(prefix="tessera-single-")
    open(f"{d}/x.csv", "w").write("a")
    with pytest.raises(ValueError):
        load_source(spark, f"{d}/x.csv")
    open(f"{d}/blank.txt", "w").write("   ")
    with pytest.raises(Exception):
        build_training_set(spark, f"{d}/blank.txt", f"{d}/out")  # one blank segment, dropped -> nothing to split


def test_dashboard(spark):
    from tessera.plans.study_plan import dashboard
    from tessera.sources import bindings as B
    t = B.trials(spark.read.parquet(f"{SF}/events.parquet"))
    d = dashboard(t, 10)
    rows = d.collect()
    assert len(rows) == t.select("study").distinct().count()
    assert all(r.status in ("new", "partial", "done") for r in rows)


def test_evaluation_plan(spark):
    from tessera.plans.evaluation_plan import evaluate
    resp = spark.createDataFrame([("base", 1, "Sorry, I cannot"), ("base", 2, "Sure"),
                                  ("cand", 1, "Here you go"), ("cand", 2, "Sure")],
                                 "model_id string, prompt_id long, response string")
    import math
    lp = spark.createDataFrame([("base", 1, [math.log(0.5)] * 2), ("cand", 1, [math.log(0.25), math.log(0.75)])],
                               "model_id string, prompt_id long, lp array<double>")
    r = {x.model_id: x for x in evaluate(resp, lp).collect()}
    assert r["base"].hits == 1 and r["cand"].hits == 0
    assert abs(r["cand"].kl - 0.143841) < 1e-6 and r["cand"].hit_score == 0.0


def test_stream_trend_out_of_order_equals_batch(spark):
    """Files arrive newest first; the live label still equals the batch one."""
    from tessera.operators import trials as TR
    from tessera.session import scratch_path
    from tessera.sources import bindings as B
    from tessera.streaming.sinks import read_latest, run_updates, stream_session
    from tessera.streaming.trials_stream import stream_trend
    t = B.trials(spark.read.parquet(f"{SF}/events.parquet"))
    src = scratch_path(spark, "t_files")
    ordered = t.withColumn("_half", F.col("trial_number") > 25)
    for half in (True, False):  # later trials first
        ordered.where(F.col("_half") == half).drop("_half").write.mode("append").parquet(src)
    stream = stream_session(spark, 4).readStream.schema(t.schema).option("maxFilesPerTrigger", "1").parquet(src)
    out, ck = scratch_path(spark, "t_out"), scratch_path(spark, "t_ck")
    run_updates(stream_trend(stream), out, ck)
    live = {r.study: (r.trend, r.last_trial) for r in read_latest(spark, out, ["study"]).collect()}
    b = TR.trend(t)
    last = b.groupBy("study").agg(F.max_by(F.struct("trend", "trial_number"), "seq").alias("x")).collect()
    batch = {r.study: (r.x.trend, r.x.trial_number) for r in last}
    assert live == batch
