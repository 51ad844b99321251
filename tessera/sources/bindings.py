"""Bind the driver's tables to the entity schemas of the data model.

Every binding is a lazy projection / aggregation of a given table, so the
work grows with the table.  Mappings:

* prompts / responses  <- ``conversations`` (user turn t -> assistant t+1)
* trials               <- ``events`` (study = user_id)
* vectors, logprobs    <- ``embeddings``
* steps                <- ``orders`` (run = o_custkey)
* bench_log            <- ``part`` (config = p_brand, batch_size = p_size)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import head_tokens
from tessera.functions.vectors import log_softmax
from tessera.operators.index import with_group_index

LAYER_WIDTH = 16
PROMPT_KEY = ["conv_id", "turn"]


def cohort_of(conv_id) -> F.Column:
    return F.when(F.col(conv_id) % 2 == 1, F.lit("bad")).otherwise(F.lit("good"))


def purpose_of(conv_id) -> F.Column:
    return F.when(F.floor(F.col(conv_id) / 2) % 5 == 0, F.lit("evaluation")).otherwise(F.lit("direction"))


def prompts(conversations: DataFrame) -> DataFrame:
    """``prompts`` schema from all user turns, answered or not; the key is
    the pair (conv_id, turn)."""
    return conversations.where(F.col("role") == "user").select(
        *PROMPT_KEY, cohort_of("conv_id").alias("cohort"), purpose_of("conv_id").alias("purpose"), "text")


def answers(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, response): the assistant turn t+1 answers turn t.  A
    projection of the assistant rows, no join."""
    return conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))


def responses(conversations: DataFrame, head: int = 20) -> DataFrame:
    """``responses`` for two models: 'base' = the full assistant answer and
    'head20' = its first ``head`` tokens (the short marker-check answer).
    One scan; every row explodes into its two models."""
    both = F.array(F.struct(F.lit("base").alias("model_id"), F.col("response")),
                   F.struct(F.lit(f"head{head}").alias("model_id"), head_tokens("response", head).alias("response")))
    return answers(conversations).select(*PROMPT_KEY, F.inline(both)).select("model_id", *PROMPT_KEY, "response")


def _trial_base(events: DataFrame) -> DataFrame:
    """Fixed-width columns of a trial, so an index carries them through its
    range partitioning instead of joining back."""
    return events.select(
        F.col("user_id").cast("string").alias("study"), "ts", "event_id",
        F.col("event_type").eqNullSafe("error").alias("_err"), (F.col("event_type") == "view").alias("_view"),
        "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _trial_columns() -> list:
    kd = F.col("k").cast("double")
    params = F.create_map(
        F.lit("attn.o_proj"), F.create_map(
            F.lit("max_weight"), F.col("value"), F.lit("max_weight_position"), kd,
            F.lit("min_weight"), kd / 4, F.lit("min_weight_distance"), kd / 2),
        F.lit("mlp.down_proj"), F.create_map(
            F.lit("max_weight"), kd, F.lit("max_weight_position"), F.col("value"),
            F.lit("min_weight"), kd / 2, F.lit("min_weight_distance"), kd / 4))
    return [F.when(F.col("_err"), F.lit("FAIL")).otherwise(F.lit("COMPLETE")).alias("state"),
            (F.col("value") / 100).alias("divergence"),
            F.col("k").alias("hits"),
            F.lit(100).alias("total"),
            params.alias("params"),
            F.when(F.col("_view"), F.lit(None).cast("double")).otherwise(kd / 4).alias("direction_index"),
            F.col("ts").alias("started_at"),
            (F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))).alias("finished_at")]


def trial_rows(events: DataFrame) -> DataFrame:
    """Trials keyed by ``event_id``, without a position in the study: a
    projection of ``events`` (no shuffle, filters reach the scan)."""
    return _trial_base(events).select("event_id", "study", *_trial_columns())


def trials(events: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """``trials`` from ``events``: study = user_id, trial_number = order of
    (ts, event_id) in the study, divergence = value / 100, hits = props.k of
    100, FAIL for 'error' events.  Parameters are derived from value and k
    with values exact at two decimals.  Use :func:`trial_rows` where the
    position is not needed."""
    idx = with_group_index(_trial_base(events), ["study"], ["ts", "event_id"], "_tn",
                           num_partitions=num_partitions)
    return idx.select("study", (F.col("_tn") + 1).cast("int").alias("trial_number"), *_trial_columns())


def vectors(embeddings: DataFrame, width: int = LAYER_WIDTH) -> DataFrame:
    """``vectors``: cohort 'a' for label < 5 else 'b'; layer = position div
    ``width`` (one row per embedding and layer; the last layer holds what is
    left, an empty or null vector gives no row)."""
    n_layers = F.ceil(F.size("embedding") / width).cast("int")
    layers = F.when(F.size("embedding") > 0, F.sequence(F.lit(0), n_layers - 1))
    e = embeddings.select("vec_id", "label", "embedding", F.explode(layers).alias("layer"))
    return e.select(
        "vec_id",
        F.when(F.col("label") < 5, F.lit("a")).otherwise(F.lit("b")).alias("cohort"),
        F.col("layer").cast("int").alias("layer"),
        F.slice("embedding", F.col("layer") * width + 1, F.lit(width)).alias("vec"))


def logprobs(embeddings: DataFrame) -> DataFrame:
    """``logprobs``: base = log_softmax(2e) for every prompt; candidate model
    'cand_<label>' = log_softmax(e) on the same prompt."""
    base = embeddings.select(F.lit("base").alias("model_id"), F.col("vec_id").alias("prompt_id"),
                             log_softmax(F.transform("embedding", lambda x: x * 2)).alias("lp"))
    cand = embeddings.select(F.concat(F.lit("cand_"), F.col("label").cast("string")).alias("model_id"),
                             F.col("vec_id").alias("prompt_id"), log_softmax("embedding").alias("lp"))
    return base.unionByName(cand)


def step_rows(orders: DataFrame) -> DataFrame:
    """Steps keyed by o_orderkey, which orders them, without a position."""
    return orders.select(F.col("o_custkey").cast("string").alias("run"), F.col("o_orderkey").alias("step"),
                         (F.col("o_totalprice") / 125000).alias("train_loss"),
                         (F.col("o_totalprice") / 100000).alias("eval_loss"))


def steps(orders: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """``steps``: run = o_custkey, step = order of o_orderkey in the run,
    eval_loss = o_totalprice / 100000, train_loss = o_totalprice / 125000."""
    o = orders.select(F.col("o_custkey").cast("string").alias("run"), "o_orderkey", "o_totalprice")
    idx = with_group_index(o, ["run"], ["o_orderkey"], "_s", num_partitions=num_partitions)
    return idx.select("run", (F.col("_s") + 1).cast("int").alias("step"),
                      (F.col("o_totalprice") / 125000).alias("train_loss"),
                      (F.col("o_totalprice") / 100000).alias("eval_loss"))


def bench_log(part: DataFrame) -> DataFrame:
    """``bench_log``: per (p_brand, p_size): tokens = rows * 100, elapsed =
    sum(p_retailprice) / 1000, ok = p_size <= 32."""
    return (part.groupBy(F.col("p_brand").alias("config"), F.col("p_size").alias("batch_size"))
            .agg((F.count(F.lit(1)) * 100).alias("tokens"),
                 (F.sum("p_retailprice") / 1000).alias("elapsed_s"))
            .select("config", F.col("batch_size").cast("int"), "elapsed_s",
                    F.col("tokens").cast("long"), (F.col("batch_size") <= 32).alias("ok")))
