"""Chat assembly from turn rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Append turns into one ordered chat per conversation (agg_conversation).

    A chat is one model input, so its size is bounded by the model context;
    the collect is per conversation (partial aggregation keeps map-side
    buffers per key), never per table.
    """
    return (turns.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
            .select(key, F.transform("_t", lambda s: F.struct(s["role"].alias("role"),
                                                               s["text"].alias("content"))).alias("chat")))
