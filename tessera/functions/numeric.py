"""Numeric scalar helpers: rates, composite score, grade, training step plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for equal results) -------------
# Composite score weights: 0.6 * divergence + 0.4 * rate_pct / 100.
COMPOSITE_WEIGHTS = (0.6, 0.4)
# Grade thresholds, checked in order; both bounds strict (<):
# (name, divergence below, rate percent below)
GRADES = [
    ("excellent", 0.15, 1.0),
    ("very_good", 0.25, 2.5),
    ("good", 0.40, 5.0),
    ("acceptable", 0.60, 10.0),
]
GRADE_ELSE = "poor"
GRADE_UNKNOWN = "unknown"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rate_pct(hits, total) -> Column:
    """hits / total * 100, and 0.0 when total is 0 (or NULL)."""
    h, t = _c(hits).cast("double"), _c(total).cast("double")
    return F.coalesce(F.try_divide(h, F.when(t != 0, t)) * 100.0, F.lit(0.0))


def composite(divergence, rate, weights=COMPOSITE_WEIGHTS) -> Column:
    """Composite score, lower is better (num_composite).  ``rate`` in %."""
    w_div, w_rate = weights
    return F.lit(w_div) * _c(divergence) + F.lit(w_rate) * _c(rate) / 100.0


def grade(divergence, rate, thresholds=GRADES) -> Column:
    """Outcome grade from divergence and rate percent (num_grade).

    First threshold where both values are strictly below wins; NULL
    divergence (no best trial yet) -> 'unknown'.
    """
    d, r = _c(divergence), _c(rate)
    expr = F.when(d.isNull(), F.lit(GRADE_UNKNOWN))
    for name, dmax, rmax in thresholds:
        expr = expr.when((d < dmax) & (r < rmax), F.lit(name))
    return expr.otherwise(F.lit(GRADE_ELSE))


def step_plan(n_rows, batch_size: int, accum_steps: int, epochs: int,
              warmup_ratio: float = 0.1):
    """Optimizer step plan (num_step_plan).

    total = n // batch // accum * epochs (floors twice, in that order);
    warmup = int(total * ratio); effective batch = batch * accum.
    Returns a dict of Columns.
    """
    n = _c(n_rows).cast("long")
    total = F.floor(F.floor(n / batch_size) / accum_steps).cast("long") * epochs
    return {
        "total_steps": total,
        "warmup_steps": F.floor(total * F.lit(warmup_ratio)).cast("long"),
        "effective_batch": F.lit(batch_size * accum_steps).cast("long"),
    }
