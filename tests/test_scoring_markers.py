"""Adaptive batch scoring, long marker lists, a stored base."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tessera.operators.evaluate import flag_responses, kl_divergence, marker_profile
from tessera.operators.marker_index import flag_rows, indexed_profile, marker_grams
from tessera.operators.scoring import score_halving, score_missing, score_rows
from tessera.operators.stored_base import kl_against, relative_against, store_base

OUT = StructType([StructField("text", StringType()), StructField("vector", ArrayType(DoubleType()))])


def limited(most, log=None):
    def make():
        def score(texts):
            if log is not None:
                log.append(len(texts))
            if sum(len(t or "") for t in texts) > most:
                raise MemoryError("out of memory")
            return [{"text": (t or "").upper(), "vector": [float(len(t or ""))]} for t in texts]
        return score
    return make


def test_batches_are_halved_and_grow_back():
    calls = []
    rows = ["aa"] * 40 + ["b" * 90] + ["c" * 200] + ["dd"] * 40
    got = list(score_halving(limited(100, calls)(), rows, 32))
    assert [r["text"] if r else None for r, _, _ in got] == [None if len(t) > 100 else t.upper() for t in rows]
    assert [e for _, e, _ in got if e] == ["MemoryError: out of memory"]
    assert got[0][2] == 32 and got[40][2] <= 2 and got[-1][2] > 2
    assert len(calls) < 30
    with pytest.raises(StopIteration):
        next(score_halving(limited(1)(), [], 8))
    wrong = list(score_halving(lambda xs: xs[:-1], ["a", "b"], 2))
    assert all(e.startswith("ValueError") for _, e, _ in wrong)


def test_score_rows_and_restart(spark, tmp_path):
    texts = [("k%d" % i, "x" * (i * 7 % 60)) for i in range(50)] + [("null", None), ("long", "y" * 300), (None, "z")]
    df = spark.createDataFrame(texts, "key string, text string").repartition(3)
    got = {r.key: (r.text, r.vector, r.error) for r in score_rows(df, "key", "text", limited(100), OUT, 16).collect()}
    want = {k: ((t or "").upper(), [float(len(t or ""))], None) for k, t in texts} | {"long": (None, None, "MemoryError: out of memory")}
    assert got == want
    path = f"{tmp_path}/scored"
    score_missing(df.where("key < 'k3'"), "key", "text", limited(100), OUT, path, 16)
    before = spark.read.parquet(path).count()
    rest = spark.read.parquet(path)
    all_ = score_missing(df, "key", "text", limited(100), OUT, path, 16)
    assert {r.key: (r.text, r.vector, r.error) for r in all_.collect()} == want
    assert rest.count() == before and spark.read.parquet(path).count() == len(texts)      # no key scored twice
    # the failed row again, with a model that takes it
    again = score_missing(df, "key", "text", limited(1000), OUT, path, 16)
    assert again.count() == len(texts) and spark.read.parquet(path).count() == len(texts) + 1
    assert again.where("error is not null").count() == 0
    with pytest.raises(ValueError):
        score_rows(df.withColumnRenamed("key", "error"), "error", "text", limited(1), OUT)


def test_long_marker_list_equals_contains(spark):
    r = random.Random(5)
    letters = "abcé *’'"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    markers = sorted({word(r.randrange(1, 9)) for _ in range(1200)} | {"A", "aB", "zzz", "b" * 12})
    texts = [(m, i, word(r.randrange(0, 60))) for m in ("x", "y") for i in range(120)] + [("x", 500, None), ("x", 501, ""), ("y", 502, "B" * 15)]
    df = spark.createDataFrame(texts, "model_id string, prompt_id long, response string")
    keys = ["model_id", "prompt_id"]
    want = {tuple(x) for x in marker_profile(df, sorted({m.lower() for m in markers}), by=["model_id"]).collect()}
    assert {tuple(x) for x in indexed_profile(df, markers, keys, by=["model_id"]).collect()} == want
    few = ["éé*a", "cabc", "bb"]
    flags = {(x.model_id, x.prompt_id): x.hit for x in flag_responses(df, few).collect()}
    assert {(x.model_id, x.prompt_id): x.hit for x in flag_rows(df, few, keys).collect()} == flags
    assert {x.hit for x in flag_rows(df, [""], keys).collect()} == {True, None}
    assert {x.hit for x in flag_rows(df, [], keys).collect()} == {False, None}
    assert indexed_profile(df.limit(0), markers, keys).count() == 0


def test_a_marker_is_known_by_its_rarest_gram(spark):
    df = spark.createDataFrame([("common text",), ("common words",), ("commonplace",)], "t string")
    got = {r.marker: r.gram for r in marker_grams(df, ["common x", "text", "ab"], "t").collect()}
    assert got == {"common x": "on x", "text": "text", "ab": "ab"}


def test_work_is_not_markers_times_texts(spark):
    df = spark.range(50).select(F.lit("m").alias("model_id"), F.col("id").alias("prompt_id"), F.lit("x").alias("response"))
    p = flag_rows(df, [f"marker{i}" for i in range(5000)], ["model_id", "prompt_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p and "NestedLoop" not in p and p.count("Contains(") + p.count("contains(") < 10


def logprobs(spark, seed=1, n=40):
    r = random.Random(seed)

    def lp():
        w = [r.random() + 1e-3 for _ in range(5)]
        return [math.log(x / sum(w)) for x in w]
    return spark.createDataFrame([(m, i, lp()) for m in ("base", "c1", "c2") for i in range(n)], "model_id string, prompt_id long, lp array<double>")


def test_stored_base_is_not_shuffled_again(spark):
    lp = logprobs(spark)
    base, cand = store_base(lp, buckets=4), lp.where("model_id <> 'base'")
    kl = kl_against(base, cand)
    got = {r.model_id: (round(r.kl, 12), r.n_prompts) for r in kl.collect()}
    assert got == {r.model_id: (round(r.kl, 12), r.n_prompts) for r in kl_divergence(lp).collect()}
    plan = kl._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(prompt_id") == 1 and "SortMergeJoin" in plan      # the candidates' side only
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_")]
    with pytest.raises(Exception, match="twice"):
        store_base(lp.unionByName(lp.where("prompt_id = 3"))).collect()
    with pytest.raises(Exception, match="twice"):
        kl_divergence(lp.unionByName(lp.where("prompt_id = 3"))).collect()


def test_relative_score_in_one_pass(spark):
    lp = logprobs(spark, 7)
    hit = lambda c: F.array_max(c) > math.log(0.4)
    got = {r.model_id: (r.kl_score, r.hit_score) for r in relative_against(store_base(lp, buckets=3), lp.where("model_id <> 'base'"), hit, 2.0).collect()}
    hits = {m: sum(max(r.lp) > math.log(0.4) for r in lp.where(F.col("model_id") == m).collect()) for m in ("base", "c1", "c2")}
    kl = {r.model_id: r.kl for r in kl_divergence(lp).collect()}
    assert {m: (round(a, 9), round(b, 9)) for m, (a, b) in got.items()} == {m: (round(kl[m] / 2, 9), round(hits[m] / hits["base"], 9)) for m in ("c1", "c2")}
    none = relative_against(store_base(lp, buckets=3), lp.where("model_id <> 'base'"), lambda c: F.lit(False))
    assert {r.hit_score for r in none.collect()} == {None}
