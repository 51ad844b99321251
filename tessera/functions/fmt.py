"""Formatting helpers: durations, quality bars, parameters, study keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for equal results) -------------
BAR_FULL, BAR_MID, BAR_LIGHT = "█", "▓", "░"
BAR_WIDTH = 10
TREND_SYMBOLS = {"improving": "▼", "degrading": "▲", "stable": "▬",
                 "insufficient_data": "?"}
NO_DIRECTION = "per layer"
STUDY_PREFIX = "study"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fmt_duration(seconds, mode: str = "round") -> Column:
    """``Hh Mm`` (seconds dropped), else ``Mm Ss``, else ``Ss``.

    mode='round' rounds half-to-even like Python ``round``; mode='trunc'
    truncates toward zero like ``int``.
    """
    x = _c(seconds).cast("double")
    if mode == "round":
        s = F.bround(x, 0).cast("long")
    elif mode == "trunc":
        s = x.cast("long")
    else:
        raise ValueError(f"mode must be 'round' or 'trunc', not {mode!r}")
    h = F.floor(s / 3600).cast("long")
    m = F.floor((s % 3600) / 60).cast("long")
    sec = s % 60
    return (F.when(h > 0, F.format_string("%dh %dm", h, m))
            .when(m > 0, F.format_string("%dm %ds", m, sec))
            .otherwise(F.format_string("%ds", sec)))


def quality_bar(value, max_value: float = 1.0) -> Column:
    """filled = int((1 - v/max) * 10) toward zero; then floor(rest/2) medium
    and the remainder light blocks.  v > max yields a bar longer than 10."""
    filled = ((F.lit(1.0) - _c(value).cast("double") / max_value) * BAR_WIDTH).cast("int")
    empty = F.lit(BAR_WIDTH) - filled
    half = F.floor(empty / 2).cast("int")
    return F.concat(F.repeat(F.lit(BAR_FULL), filled),
                    F.repeat(F.lit(BAR_MID), half),
                    F.repeat(F.lit(BAR_LIGHT), empty - half))


def trend_symbol(label) -> Column:
    m = F.create_map(*[x for k, v in TREND_SYMBOLS.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(label)]


def study_key(model_id, prefix: str = STUDY_PREFIX) -> Column:
    """``<prefix>_<last path part>_<first 8 hex of md5(full id)>``."""
    c = _c(model_id)
    last = F.regexp_extract(c, "([^/]*)/*$", 1)
    return F.concat(F.lit(prefix + "_"), last, F.lit("_"), F.substring(F.md5(c), 1, 8))


def flatten_params(trials: DataFrame, keys=("study", "trial_number"),
                   digits: int = 2) -> DataFrame:
    """One row per displayed parameter (fmt_params):
    ``component.name -> "%.2f"``, plus ``direction_index`` or 'per layer'."""
    fmt = f"%.{digits}f"
    comp = (trials.select(*keys, F.explode("params").alias("component", "inner"))
            .select(*keys, "component", F.explode("inner").alias("name", "v"))
            .select(*keys, F.concat_ws(".", "component", "name").alias("param"),
                    F.format_string(fmt, "v").alias("value")))
    di = trials.select(*keys, F.lit("direction_index").alias("param"),
                       F.when(F.col("direction_index").isNull(), F.lit(NO_DIRECTION))
                       .otherwise(F.format_string(fmt, "direction_index")).alias("value"))
    return comp.unionByName(di)


def params_to_json(col) -> Column:
    return F.to_json(_c(col))


def params_from_json(col) -> Column:
    return F.from_json(_c(col), "map<string,map<string,double>>")
