"""Fronts of one, three and more objectives against brute force; null scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import skyline, trials
from tessera.operators.skyline import dominated, pareto_front


def front(rows, signs):
    """Rows (id, study, objectives...) that no row of their study dominates."""
    def key(r):
        return [math.inf if math.isnan(s * x) else s * x for s, x in zip(signs, r[2:])]
    full = [r for r in rows if all(x is not None for x in r[2:])]
    by = {}
    for r in full:
        by.setdefault(r[1], []).append(key(r))
    out = set()
    for r in full:
        k = key(r)
        if not any(q != k and all(x <= y for x, y in zip(q, k)) for q in by[r[1]]):
            out.add(r[0])
    return out, {r[0] for r in full} - out


@pytest.mark.parametrize("k,n,cells", [(1, 200, 4096), (3, 1500, 4096), (3, 600, 8), (4, 700, 4096), (5, 400, 4096)])
def test_k_objectives(spark, monkeypatch, k, n, cells):
    monkeypatch.setattr(skyline, "GRID_CELLS", cells)
    r = random.Random(k * n)
    rows = []
    for i in range(n):
        x = [r.choice([round(r.random(), 2), float(r.randrange(4)), -0.0, 0.0]) for _ in range(k)]
        if i % 97 == 0:
            x[r.randrange(k)] = r.choice([None, float("nan"), math.inf])
        if i % 5 and k > 2:             # a hot study whose points lie near a plane: a large front
            x[-1] = float(k - sum(v or 0 for v in x[:-1] if v == v))
        rows.append((i, "hot" if i % 5 else r.choice(["a", None, "b"]), *x))
    names = [f"x{j}" for j in range(k)]
    df = spark.createDataFrame(rows, "id int, study string, " + ", ".join(f"{c} double" for c in names))
    directions = ["max" if j % 2 else "min" for j in range(k)]
    on, off = front(rows, [-1 if d == "max" else 1 for d in directions])
    assert {x.id for x in pareto_front(df, names, directions).collect()} == on
    assert {x.id for x in dominated(df, names, directions).collect()} == off
    on, _ = front([(x[0], 0, *x[2:]) for x in rows], [-1 if d == "max" else 1 for d in directions])
    got = pareto_front(df, names, directions, by=())
    assert got.columns == df.columns and {x.id for x in got.collect()} == on


def test_empty_and_bad_objectives(spark):
    df = spark.createDataFrame([], "study string, a double, b double, c double")
    assert pareto_front(df, ("a", "b", "c"), ("min",) * 3).count() == 0
    with pytest.raises(ValueError):
        pareto_front(df, ("a", "b", "c"), ("min",))


def test_no_anti_join_sees_all_rows(spark):
    """The rows that dominate each other are compared within shared grid
    coordinates only: every anti join has an equi key."""
    df = spark.range(500).select(F.lit("s").alias("study"), *[F.rand(j).alias(f"x{j}") for j in range(3)])
    plan = pareto_front(df, ("x0", "x1", "x2"), ("min",) * 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _log(spark):
    rows = [("s", 1, 0.5, 50), ("s", 2, None, 1), ("s", 3, 0.4, 40), ("s", 4, 0.9, None), ("s", 5, 0.3, 60), ("s", 6, 0.4, 40), ("s", 7, 0.2, 10)]
    df = spark.createDataFrame([(s, t, "COMPLETE", d, h, 100) for s, t, d, h in rows] + [("none", 1, "COMPLETE", None, 3, 100)],
                               "study string, trial_number int, state string, divergence double, hits int, total int")
    return df


def test_a_trial_without_score_is_never_best(spark):
    df = _log(spark)
    best = {(r.study, r.trial_number): r.best_trial for r in trials.running_best(df, bucket_size=3).collect()}
    assert best == {("s", 1): 1, ("s", 2): 1, ("s", 3): 3, ("s", 4): 3, ("s", 5): 3, ("s", 6): 3, ("s", 7): 7, ("none", 1): None}
    top = sorted((r["rank"], r.trial_number, r.starred) for r in trials.top_trials(df).collect())
    assert top == [(1, 7, True), (2, 3, False), (3, 6, False), (4, 5, False), (5, 1, False)]
    since = {r.trial_number: r.since_best for r in trials.plateau(df, bucket_size=3).where("study = 's'").collect()}
    assert since == {1: 0, 2: 1, 3: 0, 4: 1, 5: 2, 6: 3, 7: 0}


def test_a_streamed_trial_without_score_is_never_best(spark, tmp_path):
    from tessera.streaming.sinks import read_latest, run_updates, stream_session
    from tessera.streaming.trials_stream import stream_best
    df = _log(spark)
    df.unionByName(df).write.parquet(f"{tmp_path}/in")
    stream = stream_session(spark, 2).readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run_updates(stream_best(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {r.study: (r.completed, r.best_trial) for r in read_latest(spark, f"{tmp_path}/out", ["study"]).collect()}
    assert got == {"s": (7, 7), "none": (1, None)}
