"""Pareto front of any number of objectives per study (top_pareto / join_dominates).

A point - all objectives minimised after applying directions - is dominated
when another point is <= in all and < in one.  Equal points do not dominate
each other, so duplicates stay.

Two objectives, exact and without any pairs:

1. per (study, a): m(a) = min b                      (partial aggregate)
2. number the distinct (study, a) values (skew-safe global index)
3. a survives iff m(a) is a strict new minimum over smaller a - a
   bucketed cumulative argmin, so a hot study is spread over many tasks
4. a point survives iff its a survives and b = m(a)  (join back on (study, a))

Three and more objectives, exact, on distinct points:

1. a grid over quantiles of every objective; a cell is dropped when some
   occupied cell of its study lies below it in every coordinate, since all its
   points are then dominated.  Only the list of occupied cells (at most
   ``GRID_CELLS`` per study) is looked at for that
2. the front of each cell: points arrive in the order of their values, so no
   later one dominates an earlier one, and each meets the front so far only
3. a cell-front point can now be dominated only by one of a cell that shares a
   coordinate with its own: one anti join per objective on (study, coordinate)
   with the inequality, against cell fronts and never against all rows
4. equi join of the surviving points back to the rows
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import index as ix
from tessera.session import materialize

GRID_CELLS = 4096


def _oriented(col: str, direction: str):
    if direction == "min":
        return F.col(col).cast("double")
    if direction == "max":
        return -F.col(col).cast("double")
    raise ValueError("direction must be 'min' or 'max'")


def _front_keys(points: DataFrame, by, bucket_size: int) -> DataFrame:
    mins = points.groupBy(*by, "_a").agg(F.min("_b").alias("_m"))
    # The global position over (group, a) is unique and increasing in a within
    # each group - all the bucketed scan needs (no per-group renumbering).
    seq = (ix.with_global_index(mins, by + ["_a"], "_s")
           .withColumn("_s", F.col("_s") + 1))
    best = ix.cumulative_min_by(seq, by, "_s", "_s", F.struct("_m", "_s"), "_arg", bucket_size)
    return best.where(F.col("_arg") == F.col("_s")).select(*by, "_a", "_m")


def pareto_front(df: DataFrame, objectives=("divergence", "hits"), directions=("min", "min"),
                 by=("study",), bucket_size: int = 4096) -> DataFrame:
    """Rows of ``df`` on the Pareto front of the objectives per group (of all
    rows, without ``by``).  Rows with a NULL objective are excluded; with one or
    with three and more objectives NaN ranks as the worst value."""
    _check(objectives, directions)
    by = list(by)
    if len(objectives) != 2:
        return _with_front(df, objectives, directions, by, "left_semi")
    a, b = objectives
    pts = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
           .withColumn("_a", _oriented(a, directions[0]))
           .withColumn("_b", _oriented(b, directions[1])))
    keys = _front_keys(pts, by, bucket_size)
    return (ix.join_null_safe(pts, keys, by + ["_a"])
            .where(F.col("_b") == F.col("_m")).drop("_a", "_b", "_m"))


def dominated(df: DataFrame, objectives=("divergence", "hits"), directions=("min", "min"),
              by=("study",), bucket_size: int = 4096) -> DataFrame:
    """Rows dominated by some other row of their group (join_dominates): the
    anti join of ``df`` with the front, done as an equi anti join on the
    (group, a) keys of the front - or, unless there are two objectives, on the
    front's points - never a theta join over the rows."""
    _check(objectives, directions)
    by = list(by)
    if len(objectives) != 2:
        return _with_front(df, objectives, directions, by, "left_anti")
    a, b = objectives
    pts = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
           .withColumn("_a", _oriented(a, directions[0]))
           .withColumn("_b", _oriented(b, directions[1])))
    keys = _front_keys(pts, by, bucket_size)
    kept = ix.join_null_safe(pts, keys, by + ["_a"], "left")
    return kept.where(F.col("_m").isNull() | (F.col("_b") != F.col("_m"))).drop("_a", "_b", "_m")


def _check(objectives, directions):
    if not objectives or len(objectives) != len(directions):
        raise ValueError("give one direction for each objective")


def _with_front(df: DataFrame, objectives, directions, by, how: str) -> DataFrame:
    """Rows of ``df`` whose point is on the front (``left_semi``) or is not."""
    v = [f"_o{i}" for i in range(len(objectives))]
    g = [f"_g{i}" for i in range(len(by))]
    rows = df.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in objectives)))
    for name, c, d in zip(v, objectives, directions):
        x = _oriented(c, d)          # + 0.0: one zero; NaN is the worst value whatever the direction
        rows = rows.withColumn(name, F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x + F.lit(0.0)))
    points = rows.select(*[F.col(c).alias(x) for c, x in zip(by, g)], *v).distinct()
    front = _front_points(points, g, v) if len(v) > 2 else points.groupBy(*g).agg(*[F.min(c).alias(c) for c in v])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_f{c}")) for c in g] + [F.col(c) == F.col(f"_f{c}") for c in v])
    front = front.select(*[F.col(c).alias(f"_f{c}") for c in [*g, *v]])
    for c, x in zip(by, g):
        rows = rows.withColumn(x, F.col(c))
    return rows.join(front, same, how).drop(*g, *v)


def _grid(points: DataFrame, v) -> tuple[DataFrame, list[str], int]:
    """Grid coordinates ``_c0``.. of the points: in each objective the number of
    quantile bounds below the value (one aggregate, steps - 1 numbers each)."""
    steps = max(2, int(round(GRID_CELLS ** (1 / len(v)), 6)))
    shares = [i / steps for i in range(1, steps)]
    bounds = points.agg(*[F.percentile_approx(c, shares, 1000).alias(c) for c in v]).first()
    c = [f"_c{i}" for i in range(len(v))]
    for name, x in zip(c, v):
        below = [(F.col(x) > b).cast("int") for b in dict.fromkeys(bounds[x] or [])]
        points = points.withColumn(name, reduce(lambda p, q: p + q, below) if below else F.lit(0))
    return points, c, steps


def _live_cells(points: DataFrame, g, c, steps: int) -> DataFrame:
    """Occupied cells below which, in every coordinate, no occupied cell lies.
    A group has at most ``steps ** k`` cells, a number of the grid alone."""
    cells = points.select(*g, *c).distinct()
    names = cells.columns
    schema = T.StructType([cells.schema[x] for x in names])

    def live(pdf):
        import numpy as np
        at = tuple(pdf[x].to_numpy() for x in c[:-1])
        low = np.full((steps,) * len(at), steps, np.int64)
        np.minimum.at(low, at, pdf[c[-1]].to_numpy())
        for axis in range(len(at)):
            low = np.minimum.accumulate(low, axis)
        # least last coordinate among cells below in all the others
        low = np.pad(low, 1, constant_values=steps)[tuple(slice(0, steps) for _ in at)]
        return pdf[low[at] >= pdf[c[-1]].to_numpy()]
    return cells.groupBy(*g).applyInPandas(live, schema)


def _local_fronts(points: DataFrame, g, c, v) -> DataFrame:
    """The front of every (group, cell).  Within a cell points come in order of
    their values (first objective first), so no later point dominates an earlier
    one, and each is compared with the front kept so far."""
    names = points.columns
    rows = points.repartition(*g, *c).sortWithinPartitions(*g, *c, *v)
    at = [names.index(x) for x in v]
    key = [names.index(x) for x in [*g, *c]]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        last, kept, n = None, None, 0
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in key)))
            values = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in at]) if b.num_rows else np.zeros((0, len(at)))
            stay = np.zeros(b.num_rows, bool)
            for i, (k, x) in enumerate(zip(keys, values)):
                if k != last:
                    last, kept, n = k, np.empty((64, len(at))), 0
                if n and (kept[:n] <= x).all(axis=1).any():      # points are distinct
                    continue
                if n == len(kept):
                    kept = np.concatenate([kept, np.empty_like(kept)])
                kept[n] = x
                n, stay[i] = n + 1, True
            yield b.filter(pa.array(stay))
    return rows.mapInArrow(run, points.schema)


def _front_points(points: DataFrame, g, v) -> DataFrame:
    """Distinct points (groups ``g``, objectives ``v``, all minimised) that no
    point of their group dominates."""
    points, c, steps = _grid(materialize(points, "points"), v)
    live = _live_cells(points, g, c, steps)
    points = ix.join_null_safe(points, live, [*g, *c], "left_semi")
    fronts = materialize(_local_fronts(points, g, c, v), "fronts")
    out = fronts
    for shared in c:
        other = fronts.select(*[F.col(x).alias(f"{x}_") for x in [*g, *c, *v]])
        cond = F.col(shared) == F.col(f"{shared}_")
        for x in g:
            cond = cond & F.col(x).eqNullSafe(F.col(f"{x}_"))
        for x in v:
            cond = cond & (F.col(f"{x}_") <= F.col(x))
        differ = reduce(lambda p, q: p | q, (F.col(f"{x}_") < F.col(x) for x in v))
        out = out.join(other, cond & differ, "left_anti")
    return out.select(*g, *v)
