"""Registered trial-log and training-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.fmt import (flatten_params, fmt_duration, params_from_json,
                                   params_to_json, quality_bar, study_key)
from tessera.functions.numeric import grade
from tessera.operators import trials as TR
from tessera.operators.skyline import dominated, pareto_front
from tessera.operators.training import best_batch, keep_checkpoints, perplexity, usable_sweep
from tessera.plans.common import (BENCH_CTE, SCORED_CTE, STEPS_CTE, SYMBOL_SQL, TREND_CTE,
                                  TRIALS_CTE, L, T, r6)
from tessera.session import materialize, scratch_path
from tessera.sources import bindings as B
from tessera.sources.sinks import append_trials, eval_report, read_trials
from tessera.streaming.event_time import late_trials, on_time, windowed_trials
from tessera.streaming.sinks import read_latest, run_append, run_updates, stream_session
from tessera.streaming.trials_stream import resume_stream, stream_best, stream_trend

N_TRIALS = 60


def _trials(spark, sf):
    return B.trials(T(spark, sf, "events"))


def _trial_rows(spark, sf):
    return B.trial_rows(T(spark, sf, "events"))


def _micros(col):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))


def q_flt_completed(spark, sf):
    c = TR.completed(_trial_rows(spark, sf))
    return c.select("event_id", "divergence", L("hits").alias("hits"))


def q_num_composite(spark, sf):
    s = TR.scored(_trial_rows(spark, sf))
    return s.select("event_id", r6("rate_pct").alias("rate_pct"),
                    r6("score").alias("score"))


def q_num_grade(spark, sf):
    s = TR.scored(_trial_rows(spark, sf))
    return s.select("event_id", grade("divergence", "rate_pct").alias("grade"))


def q_fmt_duration(spark, sf):
    t = _trial_rows(spark, sf)
    secs = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")) * 37 / 1e6
    return t.select("event_id",
                    fmt_duration(secs, "round").alias("rounded"), fmt_duration(secs, "trunc").alias("truncated"))


def q_fmt_quality_bar(spark, sf):
    t = _trial_rows(spark, sf)
    return t.select("event_id", quality_bar("divergence").alias("bar"))


def q_fmt_params(spark, sf):
    p = flatten_params(_trial_rows(spark, sf), keys=("event_id",))
    return p.select("event_id", "param", "value")


def q_fmt_params_json(spark, sf):
    t = _trial_rows(spark, sf).withColumn("_j", params_to_json("params"))
    back = t.withColumn("_p", params_from_json("_j"))
    return back.select("event_id",
                       F.col("_p")["attn.o_proj"]["max_weight"].alias("attn_max_weight"),
                       F.col("_p")["mlp.down_proj"]["min_weight_distance"].alias("mlp_min_weight_distance"),
                       (params_to_json("_p") == F.col("_j")).alias("roundtrip_ok"))


def q_fmt_study_key(spark, sf):
    s = _trial_rows(spark, sf).select("study").distinct()
    m = F.concat(F.lit("org/model-"), F.col("study"))
    return s.select("study", study_key(m, "study").alias("key"))


def q_win_running_best(spark, sf):
    b = TR.running_best(_trials(spark, sf))
    return b.select("study", L("trial_number").alias("trial_number"), L("seq").alias("seq"),
                    L("best_trial").alias("best_trial"), "best_divergence", L("best_hits").alias("best_hits"),
                    r6("best_score").alias("best_score"))


def q_win_trend(spark, sf):
    t = TR.trend(_trials(spark, sf))
    return t.select("study", L("trial_number").alias("trial_number"), L("seq").alias("seq"),
                    r6("improvement").alias("improvement"), "trend", "symbol")


def q_win_recent_avg(spark, sf):
    r = TR.recent_avg(_trials(spark, sf))
    return r.select("study", L("trial_number").alias("trial_number"), r6("avg_divergence").alias("avg_divergence"),
                    r6("avg_rate_pct").alias("avg_rate_pct"))


def q_win_eta(spark, sf):
    e = TR.eta(_trials(spark, sf), 200)
    return e.select("study", L("trial_number").alias("trial_number"), "pct", "elapsed_s", "remaining_s")


def q_win_plateau(spark, sf):
    p = TR.plateau(_trials(spark, sf), stable_n=3, no_best_n=10)
    return p.select("study", L("trial_number").alias("trial_number"), L("stable_run").alias("stable_run"),
                    L("since_best").alias("since_best"), "stop")


def q_top_trials(spark, sf):
    t = TR.top_trials(_trials(spark, sf))
    return t.select("study", L("rank").alias("rank"), L("trial_number").alias("trial_number"), "divergence",
                    L("hits").alias("hits"), r6("score").alias("score"), "starred")


def q_top_pareto(spark, sf):
    f = pareto_front(TR.completed(_trials(spark, sf)), ("divergence", "hits"))
    return f.select("study", L("trial_number").alias("trial_number"), "divergence", L("hits").alias("hits"))


def q_join_dominates(spark, sf):
    d = dominated(TR.completed(_trials(spark, sf)), ("divergence", "hits"))
    return d.select("study", L("trial_number").alias("trial_number"))


def _three_objectives(spark, sf):
    """Completed trials with a third objective, the start, as microseconds."""
    return TR.completed(_trial_rows(spark, sf)).withColumn("started_us", _micros("started_at"))


THREE = ("divergence", "hits", "started_us"), ("min", "max", "min")


def q_top_pareto_k(spark, sf):
    f = pareto_front(_three_objectives(spark, sf), *THREE)
    return f.select("study", "event_id", "divergence", L("hits").alias("hits"), "started_us")


def q_join_dominates_k(spark, sf):
    return dominated(_three_objectives(spark, sf), *THREE).select("study", "event_id")


def q_top_pareto_all(spark, sf):
    """The front over all studies: one group holds every row."""
    f = pareto_front(_three_objectives(spark, sf), *THREE, by=())
    return f.select("study", "event_id", "divergence", L("hits").alias("hits"), "started_us")


def q_agg_run_summary(spark, sf):
    s = TR.run_summary(_trial_rows(spark, sf))
    return s.select("study", L("n_trials").alias("n_trials"), r6("total_s").alias("total_s"),
                    r6("mean_s").alias("mean_s"), "total_fmt", "mean_fmt")


def q_agg_study_catalog(spark, sf):
    c = TR.study_catalog(_trial_rows(spark, sf))
    return c.select("study", L("completed").alias("completed"), L("trials").alias("trials"),
                    _micros("last_finished").alias("last_finished_us"))


def q_agg_study_catalog_size(spark, sf):
    """The catalogue of a log in files: every study's share of the bytes, and
    whether all shares add up to the files."""
    path = scratch_path(spark, "catalog_log")
    append_trials(_trials(spark, sf), path)
    log = spark.read.parquet(path)
    c = materialize(TR.study_catalog(log, with_size=True), "catalog")
    files = log.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).distinct().agg(F.sum("b")).first()[0]
    whole = c.agg(F.sum("size_bytes")).first()[0] == files
    return c.select("study", L("completed").alias("completed"), L("trials").alias("trials"), (F.col("size_bytes") > 0).alias("has_size"),
                    F.lit(whole).alias("adds_up"))


def q_agg_resume_plan(spark, sf):
    r = TR.resume_plan(_trial_rows(spark, sf), N_TRIALS)
    return r.select("study", L("completed").alias("completed"), L("remaining").alias("remaining"), "status")


def q_snk_trial_log(spark, sf):
    path = scratch_path(spark, "trial_log")
    t = _trials(spark, sf)
    append_trials(TR.completed(t), path)
    append_trials(t, path)  # a resumed writer re-appends: read side de-duplicates
    back = read_trials(spark, path)
    return back.select("study", L("trial_number").alias("trial_number"), "state", "divergence",
                       L("hits").alias("hits"))


def q_snk_report(spark, sf):
    t = _trials(spark, sf)
    # the first trial of a study stands for the model before any change
    base = t.where("trial_number = 1").select("study", F.col("hits").alias("base_hits"))
    s = TR.scored(TR.completed(t)).where("score is not null")
    best = (s.groupBy("study").agg(F.min_by(F.struct(*[c for c in s.columns if c != "study"]),
                                            F.struct("score", "trial_number")).alias("_b"))
            .select("study", "_b.*"))
    return eval_report(best, base_hits=base, kl_digits=4)


def _stage_trials(spark, sf):
    """The trial log as files, and all of it again as a producer that
    restarted would send it: a stream must count each trial once."""
    src = scratch_path(spark, "trial_files")
    t = _trials(spark, sf)
    t.write.parquet(f"{src}/sent=1")
    spark.read.parquet(f"{src}/sent=1").write.parquet(f"{src}/sent=2")
    return src, t.schema


def q_str_running_best(spark, sf):
    src, schema = _stage_trials(spark, sf)
    stream = stream_session(spark).readStream.schema(schema).option(
        "maxFilesPerTrigger", spark.sparkContext.defaultParallelism).parquet(src)
    out, ck = scratch_path(spark, "str_best_out"), scratch_path(spark, "str_best_ckpt")
    run_updates(stream_best(stream), out, ck)
    b = read_latest(spark, out, ["study"])
    return b.select("study", L("completed").alias("completed"), L("best_trial").alias("best_trial"),
                    "best_divergence", L("best_hits").alias("best_hits"), r6("best_score").alias("best_score"))


def q_str_trend(spark, sf):
    src, schema = _stage_trials(spark, sf)
    stream = stream_session(spark).readStream.schema(schema).option(
        "maxFilesPerTrigger", spark.sparkContext.defaultParallelism).parquet(src)
    out, ck = scratch_path(spark, "str_trend_out"), scratch_path(spark, "str_trend_ckpt")
    run_updates(stream_trend(stream), out, ck)
    t = read_latest(spark, out, ["study"])
    return t.select("study", L("completed").alias("completed"), L("last_trial").alias("last_trial"),
                    r6("improvement").alias("improvement"), "trend", "symbol")


def q_str_resume(spark, sf):
    """Two runs of one query over a growing folder: first half of the log,
    stop, then the second half plus re-sent rows of the first half."""
    t = _trials(spark, sf)
    src = scratch_path(spark, "resume_files")
    cut = t.agg(F.percentile_approx(F.col("finished_at").cast("timestamp"), 0.5).alias("c")).first()["c"]
    early = F.coalesce(F.col("finished_at").cast("timestamp") <= F.lit(cut), F.lit(True))
    first, second = t.where(early), t.where(~early)
    resent = first  # the restarted producer re-sends everything it had sent
    out, ck = scratch_path(spark, "resume_out"), scratch_path(spark, "resume_ckpt")
    live = stream_session(spark)
    first.write.parquet(f"{src}/part=1")
    run_append(resume_stream(live.readStream.schema(t.schema).parquet(src)), out, ck)
    second.unionByName(resent).write.parquet(f"{src}/part=2")
    run_append(resume_stream(live.readStream.schema(t.schema).parquet(src)), out, ck)
    r = spark.read.parquet(out)
    return r.select("study", L("trial_number").alias("trial_number"), "divergence", L("hits").alias("hits"))


DELAY, WINDOW = "2 days", "1 day"


def _late_log(spark, sf):
    """The batch log and its files as they arrive: first nine trials of ten,
    then, sent late, the tenth ones and again every seventh of the first."""
    src = scratch_path(spark, "late_files")
    t = _trials(spark, sf)
    late = F.coalesce(F.pmod("trial_number", F.lit(10)) == 0, F.lit(False))
    log = materialize(t, "batch_log")
    log.where(~late).write.parquet(f"{src}/part=1")
    yield src, log
    log.where(late).unionByName(log.where(~late & (F.pmod("trial_number", F.lit(7)) == 0))).write.parquet(f"{src}/part=2")
    yield src, log


def q_str_windows(spark, sf):
    """Tumbling windows over trials by their end: two arrivals of one stream,
    stopped and started in between, the second of which is partly late."""
    out, ck = scratch_path(spark, "windows_out"), scratch_path(spark, "windows_ckpt")
    live = stream_session(spark)
    for src, log in _late_log(spark, sf):
        run_updates(windowed_trials(live.readStream.schema(log.schema).parquet(src), WINDOW, DELAY), out, ck)
    w = read_latest(spark, out, ["study", "window"])
    return w.select("study", _micros("window.start").alias("window_start_us"), L("trials").alias("trials"),
                    L("completed").alias("completed"), r6("mean_score").alias("mean_score"), r6("best_score").alias("best_score"))


def q_str_late(spark, sf):
    """Late new trials: in the batch log, but not let through by event time."""
    out, ck = scratch_path(spark, "on_time_out"), scratch_path(spark, "on_time_ckpt")
    live = stream_session(spark)
    for src, log in _late_log(spark, sf):
        run_append(on_time(live.readStream.schema(log.schema).parquet(src), DELAY), out, ck)
    late = late_trials(log, spark.read.parquet(out))
    return late.select("study", L("trial_number").alias("trial_number"), "divergence", _micros("finished_at").alias("finished_us"))


def _steps(spark, sf):
    return B.steps(T(spark, sf, "orders"))


def q_agg_perplexity(spark, sf):
    p = perplexity(B.step_rows(T(spark, sf, "orders")))
    return p.select("run", L("step").alias("step"), "eval_loss", r6("perplexity").alias("perplexity"))


def q_win_checkpoint_keep(spark, sf):
    k = keep_checkpoints(_steps(spark, sf), 3)
    return k.select("run", L("step").alias("step"), "eval_loss", L("keep_rank").alias("keep_rank"))


def q_win_first_failure(spark, sf):
    u = usable_sweep(B.bench_log(T(spark, sf, "part")))
    return u.select("config", L("batch_size").alias("batch_size"), L("tokens").alias("tokens"),
                    r6("elapsed_s").alias("elapsed_s"))


def q_agg_throughput(spark, sf):
    b = best_batch(B.bench_log(T(spark, sf, "part")))
    return b.select("config", L("batch_size").alias("batch_size"), r6("tps").alias("tps"))


QUERIES = {
    "flt_completed": q_flt_completed,
    "num_composite": q_num_composite,
    "num_grade": q_num_grade,
    "fmt_duration": q_fmt_duration,
    "fmt_quality_bar": q_fmt_quality_bar,
    "fmt_params": q_fmt_params,
    "fmt_params_json": q_fmt_params_json,
    "fmt_study_key": q_fmt_study_key,
    "win_running_best": q_win_running_best,
    "win_trend": q_win_trend,
    "win_recent_avg": q_win_recent_avg,
    "win_eta": q_win_eta,
    "win_plateau": q_win_plateau,
    "top_trials": q_top_trials,
    "top_pareto": q_top_pareto,
    "join_dominates": q_join_dominates,
    "top_pareto_k": q_top_pareto_k,
    "top_pareto_all": q_top_pareto_all,
    "join_dominates_k": q_join_dominates_k,
    "agg_run_summary": q_agg_run_summary,
    "agg_study_catalog": q_agg_study_catalog,
    "agg_study_catalog_size": q_agg_study_catalog_size,
    "agg_resume_plan": q_agg_resume_plan,
    "snk_trial_log": q_snk_trial_log,
    "snk_report": q_snk_report,
    "str_running_best": q_str_running_best,
    "str_trend": q_str_trend,
    "str_resume": q_str_resume,
    "str_windows": q_str_windows,
    "str_late": q_str_late,
    "agg_perplexity": q_agg_perplexity,
    "win_checkpoint_keep": q_win_checkpoint_keep,
    "win_first_failure": q_win_first_failure,
    "agg_throughput": q_agg_throughput,
}


def _dur_sql(mode):
    x = "(epoch_us(finished_at) - epoch_us(started_at)) * 37 / 1e6"
    s = f"CAST(round_even({x}, 0) AS BIGINT)" if mode == "round" else f"CAST(trunc({x}) AS BIGINT)"
    return f"""(CASE WHEN {s} // 3600 > 0 THEN CAST({s} // 3600 AS VARCHAR) || 'h ' || CAST(({s} % 3600) // 60 AS VARCHAR) || 'm'
             WHEN ({s} % 3600) // 60 > 0 THEN CAST(({s} % 3600) // 60 AS VARCHAR) || 'm ' || CAST({s} % 60 AS VARCHAR) || 's'
             ELSE CAST({s} % 60 AS VARCHAR) || 's' END)"""


def _dur_fmt(x):
    s = f"CAST(trunc({x}) AS BIGINT)"
    return f"""(CASE WHEN {s} // 3600 > 0 THEN CAST({s} // 3600 AS VARCHAR) || 'h ' || CAST(({s} % 3600) // 60 AS VARCHAR) || 'm'
             WHEN ({s} % 3600) // 60 > 0 THEN CAST(({s} % 3600) // 60 AS VARCHAR) || 'm ' || CAST({s} % 60 AS VARCHAR) || 's'
             ELSE CAST({s} % 60 AS VARCHAR) || 's' END)"""


_PARAMS = """params AS (
  SELECT event_id, study, trial_number, 'attn.o_proj.max_weight' AS param, printf('%.2f', value) AS value FROM trials
  UNION ALL SELECT event_id, study, trial_number, 'attn.o_proj.max_weight_position', printf('%.2f', k::DOUBLE) FROM trials
  UNION ALL SELECT event_id, study, trial_number, 'attn.o_proj.min_weight', printf('%.2f', k / 4.0) FROM trials
  UNION ALL SELECT event_id, study, trial_number, 'attn.o_proj.min_weight_distance', printf('%.2f', k / 2.0) FROM trials
  UNION ALL SELECT event_id, study, trial_number, 'mlp.down_proj.max_weight', printf('%.2f', k::DOUBLE) FROM trials
  UNION ALL SELECT event_id, study, trial_number, 'mlp.down_proj.max_weight_position', printf('%.2f', value) FROM trials
  UNION ALL SELECT event_id, study, trial_number, 'mlp.down_proj.min_weight', printf('%.2f', k / 2.0) FROM trials
  UNION ALL SELECT event_id, study, trial_number, 'mlp.down_proj.min_weight_distance', printf('%.2f', k / 4.0) FROM trials
  UNION ALL SELECT event_id, study, trial_number, 'direction_index', coalesce(printf('%.2f', direction_index), 'per layer') FROM trials)"""

_BAR = "CAST(trunc((1 - divergence / 1.0) * 10) AS INTEGER)"

_BEST_STATE = f"""WITH {SCORED_CTE},
    agg AS (SELECT study, count(*) FILTER (WHERE state = 'COMPLETE') AS completed FROM scored GROUP BY study),
    b AS (SELECT study, arg_min(trial_number, (score, trial_number)) AS best_trial FROM seqd GROUP BY study)
    SELECT agg.study, CAST(agg.completed AS BIGINT) AS completed, CAST(s.trial_number AS BIGINT) AS best_trial,
           s.divergence AS best_divergence, CAST(s.hits AS BIGINT) AS best_hits, round(s.score, 6) AS best_score
    FROM agg LEFT JOIN b ON b.study = agg.study LEFT JOIN seqd s ON s.study = b.study AND s.trial_number = b.best_trial"""

_TREND_LAST = f"""WITH {TREND_CTE},
    agg AS (SELECT study, count(*) AS completed, max(seq) AS mseq FROM seqd GROUP BY study)
    SELECT a.study, CAST(a.completed AS BIGINT) AS completed, CAST(t.trial_number AS BIGINT) AS last_trial,
           round(t.improvement, 6) AS improvement, t.trend, {SYMBOL_SQL} AS symbol
    FROM agg a JOIN trend t ON t.study = a.study AND t.seq = a.mseq"""

_THREE_CTE = "c AS (SELECT *, epoch_us(started_at) AS started_us FROM trials WHERE state = 'COMPLETE')"
_DOMINATES = """q.divergence <= p.divergence AND q.hits >= p.hits AND q.started_us <= p.started_us
          AND (q.divergence < p.divergence OR q.hits > p.hits OR q.started_us < p.started_us)"""

# The watermark after the first arrival, in whole milliseconds.
_SENT_LATE = "trial_number % 10 = 0"
_LATE_CTE = f"mark AS (SELECT max(epoch_us(finished_at)) // 1000 * 1000 - 2 * 86400000000 AS w FROM scored WHERE NOT ({_SENT_LATE}))"

ORACLES = {
    "flt_completed": f"WITH {TRIALS_CTE} SELECT event_id, divergence, CAST(hits AS BIGINT) AS hits FROM trials WHERE state = 'COMPLETE'",
    "num_composite": f"WITH {SCORED_CTE} SELECT event_id, round(rate_pct, 6) AS rate_pct, round(score, 6) AS score FROM scored",
    "num_grade": f"""WITH {SCORED_CTE} SELECT event_id,
        CASE WHEN divergence IS NULL THEN 'unknown'
             WHEN divergence < 0.15 AND rate_pct < 1.0 THEN 'excellent'
             WHEN divergence < 0.25 AND rate_pct < 2.5 THEN 'very_good'
             WHEN divergence < 0.40 AND rate_pct < 5.0 THEN 'good'
             WHEN divergence < 0.60 AND rate_pct < 10.0 THEN 'acceptable' ELSE 'poor' END AS grade FROM scored""",
    "fmt_duration": f"WITH {TRIALS_CTE} SELECT event_id, {_dur_sql('round')} AS rounded, {_dur_sql('trunc')} AS truncated FROM trials",
    "fmt_quality_bar": f"""WITH {TRIALS_CTE} SELECT event_id,
        repeat('█', greatest({_BAR}, 0)) || repeat('▓', greatest(floor((10 - {_BAR}) / 2), 0)::INTEGER)
        || repeat('░', greatest(10 - {_BAR} - floor((10 - {_BAR}) / 2)::INTEGER, 0)) AS bar FROM trials""",
    "fmt_params": f"WITH {TRIALS_CTE}, {_PARAMS} SELECT event_id, param, value FROM params",
    "fmt_params_json": f"""WITH {TRIALS_CTE} SELECT event_id, value AS attn_max_weight,
        k / 4.0 AS mlp_min_weight_distance, true AS roundtrip_ok FROM trials""",
    "fmt_study_key": f"""WITH {TRIALS_CTE}, s AS (SELECT DISTINCT study FROM trials)
        SELECT study, 'study_' || regexp_extract('org/model-' || study, '([^/]*)/*$', 1) || '_'
               || substr(md5('org/model-' || study), 1, 8) AS key FROM s""",
    "win_running_best": f"""WITH {SCORED_CTE},
        rb AS (SELECT study, trial_number, seq, arg_min(trial_number, (score, trial_number)) OVER (
                 PARTITION BY study ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_trial FROM seqd)
        SELECT rb.study, rb.trial_number, CAST(rb.seq AS BIGINT) AS seq, CAST(rb.best_trial AS BIGINT) AS best_trial,
               s.divergence AS best_divergence, CAST(s.hits AS BIGINT) AS best_hits, round(s.score, 6) AS best_score
        FROM rb JOIN seqd s ON s.study = rb.study AND s.trial_number = rb.best_trial""",
    "win_trend": f"""WITH {TREND_CTE} SELECT study, trial_number, CAST(seq AS BIGINT) AS seq,
        round(improvement, 6) AS improvement, trend, {SYMBOL_SQL} AS symbol FROM trend""",
    "win_recent_avg": f"""WITH {SCORED_CTE} SELECT study, trial_number,
        round(CASE WHEN seq >= 5 THEN avg(divergence) OVER w END, 6) AS avg_divergence,
        round(CASE WHEN seq >= 5 THEN avg(rate_pct) OVER w END, 6) AS avg_rate_pct
        FROM seqd WINDOW w AS (PARTITION BY study ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "win_eta": f"""WITH {SCORED_CTE}, st AS (SELECT study, min(started_at) AS t0 FROM trials GROUP BY study),
        e AS (SELECT s.study, s.trial_number, s.seq, (epoch_us(s.finished_at) - epoch_us(st.t0)) / 1e6 AS elapsed_s
              FROM seqd s JOIN st ON st.study = s.study)
        SELECT study, trial_number, CAST(seq AS DOUBLE) / 200.0 * 100 AS pct, elapsed_s,
               elapsed_s / seq * (200 - seq) AS remaining_s FROM e""",
    "win_plateau": f"""WITH {TREND_CTE},
        j AS (SELECT t.study, t.trial_number, t.seq,
                max(CASE WHEN t.trend <> 'stable' THEN t.seq ELSE 0 END) OVER w AS lu,
                max(CASE WHEN b.best_trial = b.trial_number THEN t.seq ELSE 0 END) OVER w AS lb
              FROM trend t JOIN best b ON b.study = t.study AND b.trial_number = t.trial_number
              WINDOW w AS (PARTITION BY t.study ORDER BY t.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT study, trial_number, CAST(seq - lu AS BIGINT) AS stable_run, CAST(seq - lb AS BIGINT) AS since_best,
               (seq - lu >= 3) OR (seq - lb >= 10) AS stop FROM j""",
    "top_trials": f"""WITH {SCORED_CTE}, c AS (SELECT * FROM scored WHERE state = 'COMPLETE'),
        e AS (SELECT study FROM c GROUP BY study HAVING count(*) >= 5),
        r AS (SELECT c.*, row_number() OVER (PARTITION BY c.study ORDER BY score, trial_number) AS rk
              FROM c WHERE c.study IN (SELECT study FROM e))
        SELECT study, CAST(rk AS BIGINT) AS rank, trial_number, divergence, CAST(hits AS BIGINT) AS hits,
               round(score, 6) AS score, rk = 1 AS starred FROM r WHERE rk <= 5""",
    "top_pareto": f"""WITH {TRIALS_CTE}, c AS (SELECT * FROM trials WHERE state = 'COMPLETE')
        SELECT p.study, p.trial_number, p.divergence, CAST(p.hits AS BIGINT) AS hits FROM c p
        WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.study = p.study AND q.divergence <= p.divergence
                          AND q.hits <= p.hits AND (q.divergence < p.divergence OR q.hits < p.hits))""",
    "join_dominates": f"""WITH {TRIALS_CTE}, c AS (SELECT * FROM trials WHERE state = 'COMPLETE')
        SELECT p.study, p.trial_number FROM c p
        WHERE EXISTS (SELECT 1 FROM c q WHERE q.study = p.study AND q.divergence <= p.divergence
                      AND q.hits <= p.hits AND (q.divergence < p.divergence OR q.hits < p.hits))""",
    "top_pareto_k": f"""WITH {TRIALS_CTE}, {_THREE_CTE}
        SELECT p.study, p.event_id, p.divergence, CAST(p.hits AS BIGINT) AS hits, p.started_us FROM c p
        WHERE p.divergence IS NOT NULL AND p.hits IS NOT NULL AND p.started_us IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM c q WHERE q.study = p.study AND {_DOMINATES})""",
    "top_pareto_all": f"""WITH {TRIALS_CTE}, {_THREE_CTE}
        SELECT p.study, p.event_id, p.divergence, CAST(p.hits AS BIGINT) AS hits, p.started_us FROM c p
        WHERE p.divergence IS NOT NULL AND p.hits IS NOT NULL AND p.started_us IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM c q WHERE {_DOMINATES})""",
    "join_dominates_k": f"""WITH {TRIALS_CTE}, {_THREE_CTE}
        SELECT p.study, p.event_id FROM c p
        WHERE EXISTS (SELECT 1 FROM c q WHERE q.study = p.study AND {_DOMINATES})""",
    "agg_run_summary": f"""WITH {TRIALS_CTE}, a AS (
          SELECT study, count(*) AS n, (epoch_us(max(finished_at)) - epoch_us(min(started_at))) / 1e6 AS tot
          FROM trials WHERE state = 'COMPLETE' GROUP BY study)
        SELECT study, CAST(n AS BIGINT) AS n_trials, round(tot, 6) AS total_s, round(tot / n, 6) AS mean_s,
               {_dur_fmt('tot')} AS total_fmt, {_dur_fmt('tot / n')} AS mean_fmt FROM a""",
    "agg_study_catalog": f"""WITH {TRIALS_CTE} SELECT study, CAST(count(*) FILTER (WHERE state = 'COMPLETE') AS BIGINT) AS completed,
        CAST(count(*) AS BIGINT) AS trials, epoch_us(max(finished_at)) AS last_finished_us FROM trials GROUP BY study""",
    "agg_study_catalog_size": f"""WITH {TRIALS_CTE} SELECT study, CAST(count(*) FILTER (WHERE state = 'COMPLETE') AS BIGINT) AS completed,
        CAST(count(*) AS BIGINT) AS trials, true AS has_size, true AS adds_up FROM trials GROUP BY study""",
    "agg_resume_plan": f"""WITH {TRIALS_CTE}, a AS (SELECT study, count(*) FILTER (WHERE state = 'COMPLETE') AS c FROM trials GROUP BY study)
        SELECT study, CAST(c AS BIGINT) AS completed, CAST(greatest({N_TRIALS} - c, 0) AS BIGINT) AS remaining,
               CASE WHEN c = 0 THEN 'new' WHEN c >= {N_TRIALS} THEN 'done' ELSE 'partial' END AS status FROM a""",
    "snk_trial_log": f"WITH {TRIALS_CTE} SELECT study, trial_number, state, divergence, CAST(hits AS BIGINT) AS hits FROM trials",
    "snk_report": f"""WITH {SCORED_CTE},
        bt AS (SELECT s.* FROM seqd s JOIN (SELECT study, arg_min(trial_number, (score, trial_number)) AS t
                                              FROM seqd GROUP BY study) b ON b.study = s.study AND b.t = s.trial_number),
        {_PARAMS.replace('FROM trials', 'FROM bt')},
        rows AS (SELECT study, string_agg('| **' || param || '** | ' || value || ' |', chr(10)
                                          ORDER BY '| **' || param || '** | ' || value || ' |') AS r FROM params GROUP BY study)
        SELECT bt.study, '## Parameters' || chr(10) || chr(10) || '| Parameter | Value |' || chr(10) || '| :-------- | :---: |'
            || chr(10) || rows.r || chr(10) || chr(10) || '## Performance' || chr(10) || chr(10)
            || '| Metric | This model | Original model |' || chr(10) || '| :----- | :--------: | :------------: |' || chr(10)
            || '| **KL divergence** | ' || printf('%.4f', bt.divergence) || ' | 0 *(by definition)* |' || chr(10)
            || '| **Hits** | ' || CAST(bt.hits AS VARCHAR) || '/' || CAST(bt.total AS VARCHAR) || ' | ' || CAST(b1.hits AS VARCHAR) || '/' || CAST(bt.total AS VARCHAR) || ' |'
            AS markdown
        FROM bt JOIN rows ON rows.study = bt.study JOIN trials b1 ON b1.study = bt.study AND b1.trial_number = 1""",
    "str_running_best": _BEST_STATE,
    "str_trend": _TREND_LAST,
    "str_resume": f"WITH {TRIALS_CTE} SELECT study, trial_number, divergence, CAST(hits AS BIGINT) AS hits FROM trials",
    "str_windows": f"""WITH {SCORED_CTE}, {_LATE_CTE}
        SELECT study, epoch_us(finished_at) // 86400000000 * 86400000000 AS window_start_us, count(*) AS trials,
               count(*) FILTER (WHERE state = 'COMPLETE') AS completed, round(avg(score) FILTER (WHERE state = 'COMPLETE'), 6) AS mean_score,
               round(min(score) FILTER (WHERE state = 'COMPLETE'), 6) AS best_score
        FROM scored, mark WHERE NOT (sent_late AND epoch_us(finished_at) <= w) GROUP BY ALL""".replace("sent_late", _SENT_LATE),
    "str_late": f"""WITH {TRIALS_CTE}, {_LATE_CTE.replace('scored', 'trials')}
        SELECT study, trial_number, divergence, epoch_us(finished_at) AS finished_us
        FROM trials, mark WHERE {_SENT_LATE} AND epoch_us(finished_at) <= w""",
    "agg_perplexity": """WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS run, max(o_orderkey) AS step,
          arg_max(o_totalprice / 100000, o_orderkey) AS el FROM orders GROUP BY o_custkey)
        SELECT run, CAST(step AS BIGINT) AS step, el AS eval_loss, round(exp(el), 6) AS perplexity FROM l""",
    "win_checkpoint_keep": f"""WITH {STEPS_CTE}, r AS (SELECT run, step, eval_loss,
          row_number() OVER (PARTITION BY run ORDER BY eval_loss, step) AS rk FROM steps)
        SELECT run, CAST(step AS BIGINT) AS step, eval_loss, CAST(rk AS BIGINT) AS keep_rank
        FROM r WHERE rk <= 3""",
    "win_first_failure": f"""WITH {BENCH_CTE} SELECT config, CAST(batch_size AS BIGINT) AS batch_size, tokens,
        round(elapsed_s, 6) AS elapsed_s FROM usable""",
    "agg_throughput": f"""WITH {BENCH_CTE}, t AS (SELECT *, tokens / elapsed_s AS tps FROM usable)
        SELECT config, CAST(arg_max(batch_size, (tps, -batch_size)) AS BIGINT) AS batch_size,
               round(max(tps), 6) AS tps FROM t GROUP BY config""",
}
