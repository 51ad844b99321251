"""State of the trial streams: runs of seen numbers, two-level trend, late rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import trials as TR
from tessera.streaming.event_time import late_trials, on_time, windowed_trials
from tessera.streaming.sinks import read_latest, run_append, run_updates, stream_session
from tessera.streaming.trial_state import BUCKETS, SLOTS, add_places, first_places, two_level_trend, unseen
from tessera.streaming.trials_stream import resume_stream, stream_best

SCHEMA = ("study string, trial_number int, state string, divergence double, hits int, total int, "
          "params map<string,map<string,double>>, finished_at timestamp_ntz")


def test_runs_hold_what_was_seen():
    r = random.Random(3)
    for _ in range(200):
        runs, seen = [], set()
        for _ in range(r.randrange(1, 8)):
            places = np.array(sorted({r.randrange(40) for _ in range(r.randrange(1, 15))}), np.int64)
            new = unseen(runs, places)
            assert [int(p) for p in places[new]] == [p for p in places.tolist() if p not in seen]
            if new.any():
                runs = add_places(runs, places[new])
            seen |= set(places.tolist())
            assert {x for a, b in runs for x in range(a, b + 1)} == seen
            assert all(b + 1 < c for (_, b), (c, _) in zip(runs, runs[1:]))      # as few runs as gaps allow
    assert add_places([], np.arange(10_000)) == [(0, 9999)]


def log(spark, n, study="hot"):
    rows = spark.range(1, n + 1).select(
        F.lit(study).alias("study"), F.col("id").cast("int").alias("trial_number"),
        F.when(F.col("id") % 11 == 0, F.lit("FAIL")).otherwise(F.lit("COMPLETE")).alias("state"),
        F.when(F.col("id") % 13 != 0, F.pmod(F.hash("id"), F.lit(100)) / 100.0).alias("divergence"),
        (F.col("id") % 7).cast("int").alias("hits"), F.lit(100).alias("total"),
        F.create_map(F.lit("a"), F.create_map(F.lit("x"), F.col("id") / 3)).alias("params"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("finished_at"))
    return rows


def test_resume_keeps_every_trial_once_and_its_state_small(spark, tmp_path):
    t = log(spark, 4000).unionByName(log(spark, 50, "small")).unionByName(
        spark.createDataFrame([("odd", None, "COMPLETE", 0.1, 1, 100, None, None), (None, 7, "FAIL", None, None, 100, {}, None)], SCHEMA))
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    live, rows = stream_session(spark, 3), []
    for part, keep in enumerate((F.col("trial_number") % 3 == 0, F.col("trial_number") % 3 == 1, F.lit(True), F.lit(True))):
        # each run starts the stream again; the last two send everything, twice
        t.where(keep).unionByName(t.where(keep)).repartition(4).write.parquet(f"{src}/part={part}")
        q = run_append(resume_stream(live.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(src), slots=4), out, ck)
        rows.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = spark.read.parquet(out)
    assert got.count() == t.count()
    assert got.select("study", "trial_number").distinct().count() == t.count()
    same = ["study", "trial_number", "divergence", "finished_at", F.to_json("params").alias("p")]
    assert got.select(same).exceptAll(t.select(same)).count() == 0
    assert rows[-1] == rows[-2] <= 4 * 3 + 2           # one run per slot once the numbers are dense, however many trials


def test_two_level_trend_equals_batch_in_any_order(spark, tmp_path):
    t = log(spark, 500).unionByName(log(spark, 9, "short")).unionByName(log(spark, 40, "b"))
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    order = F.pmod(F.hash("trial_number"), F.lit(4))
    for k in range(4):
        t.where(order == k).unionByName(t.where(order <= k)).write.parquet(f"{src}/part={k}")
    stream = stream_session(spark, 3).readStream.schema(t.schema).option("maxFilesPerTrigger", 3).parquet(src)
    q = run_updates(two_level_trend(stream, slots=4), out, ck)
    live = {r.study: (r.completed, r.last_trial, None if r.improvement is None else round(r.improvement, 9), r.trend)
            for r in read_latest(spark, out, ["study"]).collect()}
    b = TR.trend(t).groupBy("study").agg(F.max_by(F.struct("seq", "trial_number", "improvement", "trend"), "seq").alias("x")).select("study", "x.*")
    assert live == {r.study: (r.seq, r.trial_number, None if r.improvement is None else round(r.improvement, 9), r.trend) for r in b.collect()}
    upper, lower = sorted((o["numRowsTotal"] for o in q.lastProgress["stateOperators"]))
    assert upper <= 3 * 4                                  # at most one entry per study and slot in the second level
    assert lower <= 3 * 4 * 3


def test_late_rows_stay_in_the_log_only(spark, tmp_path):
    t = log(spark, 100)                                    # one trial a second
    late = F.col("trial_number").isin(10, 59, 60, 95)
    live, src = stream_session(spark, 2), f"{tmp_path}/in"
    t.where(~late).write.parquet(f"{src}/part=1")
    for part in (1, 2):
        if part == 2:                                      # watermark: 100 s less 40 s
            t.where(late).unionByName(t.where("trial_number in (5, 80)")).write.parquet(f"{src}/part=2")
        run_append(on_time(live.readStream.schema(t.schema).parquet(src), "40 seconds"), f"{tmp_path}/a", f"{tmp_path}/ca")
        run_updates(windowed_trials(live.readStream.schema(t.schema).parquet(src), "20 seconds", "40 seconds"), f"{tmp_path}/w", f"{tmp_path}/cw")
    accepted = spark.read.parquet(f"{tmp_path}/a")
    assert sorted(r.trial_number for r in late_trials(t, accepted).collect()) == [10, 59, 60]
    counts = {r.window.start.second + 60 * r.window.start.minute: r.trials
              for r in read_latest(spark, f"{tmp_path}/w", ["study", "window"]).collect()}
    assert counts == {0: 19 - 1, 20: 20, 40: 20 - 1, 60: 20 - 1, 80: 20, 100: 1}


def test_a_stream_changes_no_setting_of_its_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.session.timeZone")
    own = stream_session(spark, 3)
    assert own.conf.get("spark.sql.shuffle.partitions") == "3" and own.conf.get("spark.sql.session.timeZone") == before[1]
    assert (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.session.timeZone")) == before


def test_runs_of_many_studies_hold_what_was_seen():
    r = random.Random(5)
    for _ in range(100):
        runs, seen = (np.array([], np.int64),) * 3, set()
        for _ in range(r.randrange(1, 6)):
            rows = [(r.randrange(5), r.choice([-(1 << 62), *range(30)])) for _ in range(r.randrange(1, 60))]
            new, runs = first_places(runs, *np.array(rows, np.int64).T)
            first = {x: i for i, x in reversed(list(enumerate(rows)))}
            assert [i for i, x in enumerate(new) if x] == sorted(i for x, i in first.items() if x not in seen)
            seen |= set(rows)
            held = list(zip(*(x.tolist() for x in runs)))
            assert {(g, x) for g, a, b in held for x in range(a, b + 1)} == seen and held == sorted(held)
            assert all(g != h or b + 1 < c for (g, _, b), (h, c, _) in zip(held, held[1:]))


def many_studies(spark, n=3000):
    t = log(spark, 4 * n).withColumn("study", F.expr(f"cast((trial_number - 1) div 4 as string)"))
    return t.withColumn("trial_number", F.expr("(trial_number - 1) % 4 + 1"))


def test_resume_of_many_studies_takes_a_bounded_number_of_state_groups(spark, tmp_path):
    t = many_studies(spark)
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    for part, keep in enumerate(("trial_number <> 2", "true")):
        t.where(keep).repartition(2).write.parquet(f"{src}/part={part}")
        q = run_append(resume_stream(stream_session(spark, 3).readStream.schema(t.schema).parquet(src)), out, ck)
    got, same = spark.read.parquet(out), ["study", "trial_number", "divergence", "finished_at", F.to_json("params").alias("p")]
    assert got.count() == t.count() and got.select(same).exceptAll(t.select(same)).count() == 0
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= BUCKETS * SLOTS


def test_best_of_many_studies_takes_a_bounded_number_of_state_groups(spark, tmp_path):
    t = many_studies(spark)
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    t.repartition(2).write.parquet(f"{src}/sent=1")
    t.repartition(2).write.parquet(f"{src}/sent=2")
    q = run_updates(stream_best(stream_session(spark, 3).readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(src)), out, ck)
    live = {r.study: (r.completed, r.best_trial) for r in read_latest(spark, out, ["study"]).collect()}
    done = TR.scored(t).where("state = 'COMPLETE'")
    best = F.min_by("trial_number", F.when(F.col("score").isNotNull(), F.struct("score", "trial_number")))
    want = {r.study: (r.n, r.b) for r in done.groupBy("study").agg(F.count(F.lit(1)).alias("n"), best.alias("b")).collect()}
    assert len(live) == 3000 and all(live[s] == x for s, x in want.items())
    seen, agg = sorted(o["numRowsTotal"] for o in q.lastProgress["stateOperators"])
    assert seen <= BUCKETS * SLOTS and agg == 3000


def test_trend_of_many_studies_takes_a_bounded_number_of_state_groups(spark, tmp_path):
    t = many_studies(spark).unionByName(log(spark, 300))
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    for part, keep in enumerate(("trial_number % 5 <> 2", "true")):
        t.where(keep).repartition(2).write.parquet(f"{src}/part={part}")
    q = run_updates(two_level_trend(stream_session(spark, 3).readStream.schema(t.schema).parquet(src), w=4), out, ck)
    live = {r.study: (r.completed, r.last_trial, None if r.improvement is None else round(r.improvement, 9), r.trend)
            for r in read_latest(spark, out, ["study"]).collect()}
    b = TR.trend(t, 4).groupBy("study").agg(F.max_by(F.struct("seq", "trial_number", "improvement", "trend"), "seq").alias("x")).select("study", "x.*")
    assert live == {r.study: (r.seq, r.trial_number, None if r.improvement is None else round(r.improvement, 9), r.trend) for r in b.collect()}
    slots, studies = sorted(o["numRowsTotal"] for o in q.lastProgress["stateOperators"])
    assert slots <= 2 * BUCKETS * SLOTS and studies <= 3001
