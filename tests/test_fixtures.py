"""Fixture cases (expected values worked out from the reference's tests
and code; see FIXTURES.md)."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import fmt, numeric, text, vectors
from tessera.operators import centroids, chunking, evaluate, examples, skyline, split, trials, training
from tessera.sources import corpus


def trials_df(spark, rows, study="s"):
    """rows: (divergence, hits[, total, state])"""
    data = []
    for i, r in enumerate(rows, start=1):
        d, h = r[0], r[1]
        total = r[2] if len(r) > 2 else 200
        state = r[3] if len(r) > 3 else "COMPLETE"
        data.append(Row(study=study, trial_number=i, state=state, divergence=float(d), hits=int(h), total=int(total)))
    return spark.createDataFrame(data)


def one(df):
    return df.collect()


# ---- rates, grades, composite -------------------------------------------
def test_rate(spark):
    r = spark.range(1).select(numeric.rate_pct(F.lit(5), F.lit(200)).alias("a"),
                              numeric.rate_pct(F.lit(0), F.lit(0)).alias("b")).first()
    assert r.a == 2.5 and r.b == 0.0


@pytest.mark.parametrize("d,h,expected", [(0.10, 1, "excellent"), (0.30, 8, "good"), (0.80, 30, "poor"),
                                          (0.15, 1, "very_good"), (0.25, 2, "good")])
def test_grade(spark, d, h, expected):
    g = spark.range(1).select(numeric.grade(F.lit(d), numeric.rate_pct(F.lit(h), F.lit(200))).alias("g")).first().g
    assert g == expected


def test_grade_unknown(spark):
    assert spark.range(1).select(numeric.grade(F.lit(None).cast("double"), F.lit(0.0)).alias("g")).first().g == "unknown"


# ---- running best, ties ---------------------------------------------------
def _final_best(spark, rows):
    b = trials.running_best(trials_df(spark, rows))
    return b.orderBy(F.desc("seq")).first().best_trial


def test_best_of_three(spark):
    assert _final_best(spark, [(0.50, 10), (0.25, 5), (0.60, 15)]) == 2


def test_lower_divergence_wins(spark):
    assert _final_best(spark, [(0.20, 5), (0.40, 5)]) == 1


def test_lower_rate_wins(spark):
    assert _final_best(spark, [(0.30, 2), (0.30, 10)]) == 1


def test_tie_keeps_earlier(spark):
    assert _final_best(spark, [(0.30, 2), (0.30, 2)]) == 1


def test_running_best_across_buckets(spark):
    rows = [(0.5 - 0.001 * i if i % 7 else 0.9, 3) for i in range(40)]
    b = trials.running_best(trials_df(spark, rows), bucket_size=4).orderBy("seq").collect()
    best, best_t = None, None
    for i, r in enumerate(rows, start=1):
        score = 0.6 * r[0] + 0.4 * (r[1] / 200 * 100) / 100
        if best is None or score < best:
            best, best_t = score, i
        assert b[i - 1].best_trial == best_t


# ---- trend ----------------------------------------------------------------
def _last_trend(spark, rows, w=10, bucket_size=4096):
    t = trials.trend(trials_df(spark, rows), w=w, bucket_size=bucket_size)
    return t.orderBy(F.desc("seq")).first()


def test_trend_short(spark):
    r = _last_trend(spark, [(0.3, 5)] * 5)
    assert (r.trend, r.symbol) == ("insufficient_data", "?")


def test_trend_improving(spark):
    r = _last_trend(spark, [(0.50 - 0.04 * i, 10 - i) for i in range(10)])
    assert (r.trend, r.symbol) == ("improving", "▼")


def test_trend_degrading(spark):
    r = _last_trend(spark, [(0.20 + 0.04 * i, 2 + i) for i in range(10)])
    assert (r.trend, r.symbol) == ("degrading", "▲")


def test_trend_stable(spark):
    r = _last_trend(spark, [(0.3, 5)] * 10)
    assert (r.trend, r.symbol) == ("stable", "▬")


def test_trend_odd_window(spark):
    # w=5: first 2 vs last 3
    rows = [(0.9, 0), (0.9, 0), (0.1, 0), (0.1, 0), (0.1, 0)]
    r = _last_trend(spark, rows, w=5)
    assert math.isclose(r.improvement, 0.6 * 0.9 - 0.6 * 0.1, rel_tol=1e-9)


def test_trend_halo_matches_unbucketed(spark):
    rows = [(0.5 + 0.1 * math.sin(i), i % 13) for i in range(60)]
    a = trials.trend(trials_df(spark, rows), bucket_size=4096).orderBy("seq").collect()
    b = trials.trend(trials_df(spark, rows), bucket_size=9).orderBy("seq").collect()
    assert [(x.trend, round(x.improvement or 0, 9)) for x in a] == [(x.trend, round(x.improvement or 0, 9)) for x in b]


def test_fifty_trial_run(spark):
    rows = [(max(0.15, 0.50 - 0.01 * i), max(2, 15 - i // 3)) for i in range(50)]
    t = trials_df(spark, rows)
    best = trials.running_best(t).orderBy(F.desc("seq")).first()
    assert best.best_divergence <= 0.20
    assert _last_trend(spark, rows).trend in ("improving", "stable")
    g = spark.range(1).select(numeric.grade(F.lit(best.best_divergence),
                                            numeric.rate_pct(F.lit(best.best_hits), F.lit(200))).alias("g")).first().g
    assert g in ("excellent", "very_good", "good")


# ---- bars, durations, params ---------------------------------------------
@pytest.mark.parametrize("v,full,mid,light", [(0.5, 5, 2, 3), (2.0, 0, 10, 10), (0.0, 10, 0, 0)])
def test_quality_bar(spark, v, full, mid, light):
    b = spark.range(1).select(fmt.quality_bar(F.lit(v)).alias("b")).first().b
    assert b == "█" * full + "▓" * mid + "░" * light


ROUNDED = {0: "0s", 30: "30s", 59: "59s", 60: "1m 0s", 90: "1m 30s", 125: "2m 5s", 3600: "1h 0m",
           3665: "1h 1m", 7325: "2h 2m", 90.7: "1m 31s"}
TRUNC = {30: "30s", 90: "1m 30s", 3661: "1h 1m", 7200: "2h 0m", 90.7: "1m 30s"}


def test_durations(spark):
    for mode, cases in (("round", ROUNDED), ("trunc", TRUNC)):
        for secs, expected in cases.items():
            got = spark.range(1).select(fmt.fmt_duration(F.lit(float(secs)), mode).alias("d")).first().d
            assert got == expected, (mode, secs)


def test_duration_half_even(spark):
    got = spark.range(1).select(fmt.fmt_duration(F.lit(2.5), "round").alias("d")).first().d
    assert got == "2s"


def test_params_flat(spark):
    from tessera.schemas import PARAMS
    df = spark.createDataFrame([("s", 1, {"attn": {"max_weight": 1.0}}, None)],
                               f"study string, trial_number int, params {PARAMS.simpleString()}, direction_index double")
    got = {r.param: r.value for r in fmt.flatten_params(df).collect()}
    assert got == {"attn.max_weight": "1.00", "direction_index": "per layer"}


def test_params_json_roundtrip(spark):
    from tessera.schemas import PARAMS
    p = {"attn": {"max_weight": 1.25, "min_weight": 0.5}, "mlp": {"max_weight": 2.0}}
    df = spark.createDataFrame([(p,)], f"params {PARAMS.simpleString()}")
    back = df.select(fmt.params_from_json(fmt.params_to_json("params")).alias("p")).first().p
    assert back == p


def test_study_key(spark):
    import hashlib
    k = spark.range(1).select(fmt.study_key(F.lit("org/some-model"), "study").alias("k")).first().k
    assert k == "study_some-model_" + hashlib.md5(b"org/some-model").hexdigest()[:8]


def test_step_plan(spark):
    plan = numeric.step_plan(F.lit(1000), 4, 8, 3, 0.1)
    r = spark.range(1).select(*[v.alias(k) for k, v in plan.items()]).first()
    assert (r.total_steps, r.warmup_steps, r.effective_batch) == (93, 9, 32)


# ---- Pareto, resume, sweep -------------------------------------------------
def test_pareto(spark):
    pts = [(1, 5), (2, 3), (2, 3), (3, 4), (4, 1)]
    df = spark.createDataFrame([("s", i, float(a), b) for i, (a, b) in enumerate(pts)],
                               "study string, trial_number int, divergence double, hits int")
    got = sorted((r.divergence, r.hits) for r in skyline.pareto_front(df).collect())
    assert got == [(1.0, 5), (2.0, 3), (2.0, 3), (4.0, 1)]
    dom = sorted((r.divergence, r.hits) for r in skyline.dominated(df).collect())
    assert dom == [(3.0, 4)]


def test_resume(spark):
    rows = [(0.3, 5)] * 150 + [(0.3, 5, 200, "FAIL")]
    r = trials.resume_plan(trials_df(spark, rows), 200).first()
    assert (r.completed, r.remaining, r.status) == (150, 50, "partial")
    r = trials.resume_plan(trials_df(spark, [(0.3, 5)] * 200), 150).first()
    assert (r.remaining, r.status) == (0, "done")


def test_sweep_and_throughput(spark):
    log = spark.createDataFrame([("c", 1, 1.0, 100, True), ("c", 2, 1.0, 150, True), ("c", 4, 1.0, 400, True),
                                 ("c", 8, 1.0, 800, False), ("c", 16, 1.0, 5000, True)],
                                "config string, batch_size int, elapsed_s double, tokens long, ok boolean")
    assert sorted(r.batch_size for r in training.usable_sweep(log).collect()) == [1, 2, 4]
    assert training.best_batch(log).first().batch_size == 4
    tie = spark.createDataFrame([("c", 4, 1.0, 400, True), ("c", 8, 2.0, 800, True)],
                                "config string, batch_size int, elapsed_s double, tokens long, ok boolean")
    assert training.best_batch(tie).first().batch_size == 4


def test_sweep_smallest_failure_raises(spark):
    log = spark.createDataFrame([("c", 1, 1.0, 100, False)],
                                "config string, batch_size int, elapsed_s double, tokens long, ok boolean")
    with pytest.raises(Exception):
        training.usable_sweep(log).collect()


# ---- text ------------------------------------------------------------------
@pytest.mark.parametrize("resp,hit", [("I *cannot* help", True), ("I won’t do that", True),
                                      ("That was a violation", True), ("The capital is Paris.", False)])
def test_marker_flags(spark, resp, hit):
    df = spark.createDataFrame([(resp,)], "response string")
    assert evaluate.flag_responses(df).first().hit is hit


def test_marker_head_only(spark):
    resp = " ".join(["word"] * 20 + ["sorry"])
    df = spark.createDataFrame([(resp,)], "response string")
    assert evaluate.flag_responses(df, head=20).first().hit is False
    assert evaluate.flag_responses(df).first().hit is True


def test_empty_marker_list(spark):
    df = spark.createDataFrame([("sorry",)], "response string")
    assert evaluate.flag_responses(df, markers=[]).first().hit is False


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "a\n\n \n\nb"), (2, "   ")], "doc_id long, text string")
    got = sorted((r.doc_id, r.segment_no, r.text) for r in corpus.to_segments(df).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "   ")]


def _chunks(spark, n, size=1024, overlap=128):
    text_ = " ".join(f"t{i}" for i in range(n))
    df = spark.createDataFrame([(1, text_)], "doc_id long, text string")
    return chunking.chunk_tokens(chunking.with_tokens(df), size, overlap, keep=["doc_id"], min_n=50) \
        .orderBy("chunk_no").collect(), text_


@pytest.mark.parametrize("n,starts,lengths", [(49, [], []), (50, [0], [50]), (1024, [0], [1024]),
                                              (1025, [0, 896], [1024, 129]), (1920, [0, 896], [1024, 1024]),
                                              (1921, [0, 896, 1792], [1024, 1024, 129])])
def test_chunking(spark, n, starts, lengths):
    rows, text_ = _chunks(spark, n)
    assert [r.start_token for r in rows] == starts
    assert [r.n_tokens for r in rows] == lengths
    if len(rows) == 1:
        assert rows[0].text == text_


def test_chunk_overlap_validation(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        chunking.chunk_tokens(chunking.with_tokens(df), 10, 10)


def test_topic(spark):
    df = spark.createDataFrame([("Short. rest of a longer chunk",), ("A long enough first sentence. x",)], "t string")
    got = [r.tp for r in df.select(text.topic("t").alias("tp")).collect()]
    assert got == ["Short. rest of a longer chunk", "A long enough first sentence"]


def test_template_cycle(spark):
    df = spark.range(9).select(F.col("id").alias("k"))
    got = {r.k: r.template for r in examples.assign_template(df, ["k"]).collect()}
    assert got[0] == examples.TEMPLATES[0] and got[7] == examples.TEMPLATES[7] and got[8] == examples.TEMPLATES[0]


def test_split_stable_disjoint_exhaustive(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    a = {r.k: r.split for r in split.split_train_val(df, "k").collect()}
    b = {r.k: r.split for r in split.split_train_val(df.repartition(7), "k").collect()}
    assert a == b and len(a) == 1000 and set(a.values()) == {"train", "validation"}
    assert 850 <= sum(v == "train" for v in a.values()) <= 950
    e = split.split_train_val(df, "k", exact=True)
    assert e.where("split = 'train'").count() == 900


def test_strip_prompt(spark):
    df = spark.createDataFrame([("Hello", "Hello   world  ")], "p string, r string")
    assert df.select(text.strip_prompt("r", "p").alias("a")).first().a == "world"


# ---- vectors ---------------------------------------------------------------
def _lp(vals):
    return [math.log(v) for v in vals]


def test_kl(spark):
    rows = [("base", 1, _lp([0.5, 0.5])), ("cand", 1, _lp([0.25, 0.75]))]
    df = spark.createDataFrame(rows, "model_id string, prompt_id long, lp array<double>")
    assert abs(evaluate.kl_divergence(df).first().kl - 0.143841) < 1e-6
    rows2 = rows + [("base", 2, _lp([0.5, 0.5])), ("cand", 2, _lp([0.5, 0.5]))]
    df2 = spark.createDataFrame(rows2, "model_id string, prompt_id long, lp array<double>")
    assert abs(evaluate.kl_divergence(df2).first().kl - 0.071921) < 1e-6


def test_kl_length_mismatch_raises(spark):
    rows = [("base", 1, [-0.69, -0.69]), ("cand", 1, [-0.69])]
    df = spark.createDataFrame(rows, "model_id string, prompt_id long, lp array<double>")
    with pytest.raises(Exception):
        evaluate.kl_divergence(df).collect()


def test_log_softmax(spark):
    r = spark.createDataFrame([([0.0, 0.0],), ([1000.0, 0.0],)], "x array<double>") \
        .select(vectors.log_softmax("x").alias("y")).collect()
    assert all(abs(v + math.log(2)) < 1e-9 for v in r[0].y)
    assert abs(r[1].y[0]) < 1e-9  # no overflow


def test_contrast(spark):
    rows = [(1, "zero", 0, [0.0, 0.0]), (2, "tf", 0, [3.0, 4.0]), (3, "tf", 0, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, cohort string, layer int, vec array<double>")
    for method in ("explode", "summarizer"):
        r = centroids.centroid_contrast(df, "zero", "tf", method=method).first()
        assert [round(v, 9) for v in r.direction] == [0.6, 0.8] and abs(r.norm - 5) < 1e-12
    z = spark.createDataFrame([(1, "a", 0, [1.0, 2.0]), (2, "b", 0, [1.0, 2.0])],
                              "vec_id long, cohort string, layer int, vec array<double>")
    r = centroids.centroid_contrast(z, "a", "b").first()
    assert r.direction == [0.0, 0.0] and r.norm == 0.0


def test_relative_score_zero_base(spark):
    m = spark.createDataFrame([("base", 0.0, 0), ("c", 0.2, 3)], "model_id string, kl double, hits long")
    r = evaluate.relative_score(m).first()
    assert r.hit_score is None and abs(r.kl_score - 0.2) < 1e-12
