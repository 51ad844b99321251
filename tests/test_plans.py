"""Physical-plan checks: native operators stay JVM-side, filters and
columns reach the scan, ordered windows are not keyed by the group alone."""

import pytest

from tessera.plans import corpus_queries as C
from tessera.plans import eval_queries as EQ
from tessera.plans import trial_queries as TQ

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunking_has_no_python(spark):
    p = plan(C.chunks(spark, SF))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "WholeStageCodegen" in p or "*(" in p


def test_completed_filter_pushed_to_scan(spark):
    p = plan(TQ.q_flt_completed(spark, SF))
    pushed = p.split("PushedFilters: [")[1].split("]")[0]
    assert "event_type" in pushed and "error" in pushed
    assert "Exchange" not in p
    read = p.split("ReadSchema: ")[1].splitlines()[0]
    assert "ts:" not in read


@pytest.mark.parametrize("query", [TQ.q_num_grade, TQ.q_fmt_duration, TQ.q_fmt_params_json, EQ.q_txt_normalize,
                                   EQ.q_txt_marker_flag, EQ.q_txt_chat])
def test_projections_do_not_shuffle(spark, query):
    assert "Exchange" not in plan(query(spark, SF))


def test_running_best_windows_are_bucketed(spark):
    p = plan(TQ.q_win_running_best(spark, SF))
    # a window over trials is partitioned by (study, bucket); only the carry over
    # bucket summaries is partitioned by study alone
    windows = [x for x in p.splitlines() if "Window [" in x and "min(_v1" in x]
    assert windows and all("_bkt" in x for x in windows)


def test_plateau_is_one_frame(spark):
    from tessera.operators import trials as TR
    df = spark.range(20).selectExpr("'a' AS study", "int(id + 1) AS trial_number", "'COMPLETE' AS state",
                                    "id / 10.0D AS divergence", "1 AS hits", "100 AS total")
    # one carry join per cumulative pass; the second pass shows the first in both its
    # branches (one exchange, reused).  Trend and best are not joined.
    joins = TR.plateau(df)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins == 3


def test_idx_global_has_no_single_partition_exchange(spark):
    df = C.q_idx_global(spark, SF)
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    p = qe.executedPlan().toString()
    assert "SinglePartition" not in p


def test_indexes_on_empty_input(spark):
    from tessera.operators import index as ix
    e = spark.createDataFrame([], "g string, o long, v double")
    assert ix.with_global_index(e, ["g", "o"]).count() == 0
    assert ix.with_group_index(e, ["g"], ["o"]).count() == 0
