"""Skew-safe positional operators: global index, index within group,
cumulative and sliding aggregates over ordered groups.

None of these uses an unpartitioned window over the data or puts a whole
group into one task:

* ``with_global_index`` range-partitions on the order key, numbers rows
  inside each range with ``monotonically_increasing_id`` (written once to
  the shared checkpoint folder) and adds per-range offsets.  The offsets
  table has one row per range partition (a proven bound), so it is
  broadcast.
* ``with_group_index`` derives the index inside a group from the global
  index minus the group's first index; the group minimum is a partial
  (map-side combined) aggregate and joins back on the group key, where AQE
  splits a hot group (skew join) or broadcasts a small table by measured size.
* ``cumulative_*`` / ``sliding_*`` split every group into fixed-size buckets
  of its dense sequence number.  Windows run per (group, bucket); a carry
  from earlier buckets (cumulative) or a halo of the previous ``w-1`` rows
  (sliding) makes the result exact.  A group holding a third of all rows is
  spread over ``n / bucket_size`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir, materialize

_MASK33 = (1 << 33) - 1


def _cols(cols):
    if cols is None:
        return []
    if isinstance(cols, (str, Column)):
        return [cols]
    return list(cols)


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return int(n)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _carried(df: DataFrame, names):
    """Non-key columns small enough to travel with the keys: fixed-width
    types only (strings, arrays and maps could be arbitrarily large)."""
    extra = [f for f in df.schema.fields if f.name not in names]
    if all(isinstance(f.dataType, _FIXED_WIDTH) for f in extra):
        return [f.name for f in extra]
    return []


def _ranged(df: DataFrame, names, num_partitions: int | None, carry=()) -> DataFrame:
    """Key (+ carried) columns range-partitioned on ``names``, sorted, with
    ``_pid`` (range partition) and ``_loc`` (position inside it).

    The numbered rows are written once as a Parquet table in the shared
    ``spark.checkpoint.dir`` (one job; survives executor loss): every later
    branch must see the *same* range bounds, and Spark samples bounds per
    exchange.  Partition identity is kept as data (``_mid``), so later passes
    do not depend on the physical file split and can prune columns.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sel = df.select(*names, *carry)
    # Without an explicit count AQE may coalesce adjacent ranges to its target
    # partition size; coalesced ranges stay contiguous, so order is kept.
    ranged = (sel.repartitionByRange(int(num_partitions), *names) if num_partitions
              else sel.repartitionByRange(*names))
    numbered = ranged.sortWithinPartitions(*names).withColumn("_mid", F.monotonically_increasing_id())
    return (materialize(numbered, "index")
            .withColumn("_pid", F.shiftright("_mid", 33))
            .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_MASK33)))
            .drop("_mid"))


def _offsets(spark, counts):
    """Exclusive prefix sums of per-range-partition counts (at most ``n``
    numbers, the same metadata ``RDD.zipWithIndex`` gathers) as a local
    table for a broadcast join - no single-partition exchange and no data
    on the driver."""
    offs, acc = {}, 0
    for pid, cnt in sorted(counts):
        offs[pid] = acc
        acc += cnt
    return offs, spark.createDataFrame(sorted(offs.items()), "_pid long, _off long")


def _narrow_index(df: DataFrame, names, idx_col: str, num_partitions: int | None, carry=()):
    """(key..., carry..., idx) for the key columns of ``df`` in key order."""
    ranged = _ranged(df, names, num_partitions, carry)
    counts = [(r[0], r[1]) for r in ranged.groupBy("_pid").agg(F.count(F.lit(1))).collect()]
    _, offsets = _offsets(df.sparkSession, counts)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .select(*names, *carry, (F.col("_off") + F.col("_loc")).cast("long").alias(idx_col)))


def _names(cols):
    names = [k if isinstance(k, str) else None for k in _cols(cols)]
    if None in names:
        raise ValueError("order and group keys must be column names")
    return names


def _join_back(df: DataFrame, idx: DataFrame, names, idx_col: str) -> DataFrame:
    """Attach ``idx_col`` to the wide rows: one null-safe equi join on the
    unique key (wide rows shuffled once; AQE broadcasts a small index)."""
    if set(df.columns) <= set(idx.columns):
        return idx.select(*df.columns, idx_col)
    ren = idx.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], idx_col)
    cond = [df[k].eqNullSafe(ren[f"_k{i}"]) for i, k in enumerate(names)]
    return df.join(ren, cond).drop(*[f"_k{i}" for i in range(len(names))])


def with_global_index(df: DataFrame, order_by, idx_col: str = "idx",
                      num_partitions: int | None = None) -> DataFrame:
    """Contiguous 0-based index over all rows in ``order_by`` order.

    ``order_by`` must be a total order (unique key): ties would make the
    numbering depend on shuffle fetch order.  The index is computed on the
    key columns (see :func:`_narrow_index`).  Fixed-width columns travel
    with the keys (no join back); rows with strings, arrays or maps join the
    (key, idx) table back on the unique key, so wide rows are shuffled once
    and never sampled or checkpointed.
    """
    names = _names(order_by)
    carry = _carried(df, names)
    return _join_back(df, _narrow_index(df, names, idx_col, num_partitions, carry), names, idx_col)


def with_group_index(df: DataFrame, group_by, order_by, idx_col: str = "idx",
                     num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its group, in ``order_by`` order.

    (group_by + order_by) must be unique.  Equivalent to
    ``row_number() over (partition by group order by order) - 1`` without
    ever shuffling on the group key alone (a hot group would land in one
    task, and later group-keyed operators would inherit that layout):

    1. global index over (group, order) on range partitions;
    2. each group's start inside its range partition: a window over
       (partition, group) - balanced, no piece exceeds one range partition;
    3. only the first group of a partition can have started earlier: a
       boundary table with one row per range partition (at most ``n``,
       broadcast) carries its true start across partitions.
    """
    g, o = _names(group_by), _names(order_by)
    names = g + o
    carry = _carried(df, names)
    ranged = _ranged(df, names, num_partitions, carry)
    gkey = F.struct(*[F.col(c) for c in g])
    # One small collect: per range partition its row count, first group, and
    # last group with that group's first position (at most n rows).
    per_pg = ranged.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_c"), F.min("_loc").alias("_lo"),
                                           F.max("_loc").alias("_hi"))
    summ = per_pg.groupBy("_pid").agg(
        F.sum("_c").alias("cnt"), F.min_by(gkey, "_lo").alias("fg"),
        F.max_by(F.struct(gkey.alias("g"), F.col("_lo").alias("lo")), "_hi").alias("last")).collect()
    offs, offsets = _offsets(df.sparkSession, [(r["_pid"], r["cnt"]) for r in summ])
    # Driver-side walk over the partition summaries: the true start of each
    # partition's first group (it may have begun in an earlier partition).
    rows, prev_lg, prev_start = [], None, None
    for r in sorted(summ, key=lambda x: x["_pid"]):
        off = offs[r["_pid"]]
        start_first = prev_start if (prev_lg is not None and r["fg"] == prev_lg) else off
        lg = r["last"]["g"]
        start_last = start_first if lg == r["fg"] else off + r["last"]["lo"]
        rows.append((r["_pid"], *[r["fg"][c] for c in g], start_first))
        prev_lg, prev_start = lg, start_last
    gi = (ranged.join(F.broadcast(offsets), "_pid")
          .withColumn("_gidx", (F.col("_off") + F.col("_loc")).cast("long"))
          .withColumn("_lstart", F.min("_gidx").over(Window.partitionBy("_pid", *g))))
    schema = T.StructType([T.StructField("_pid", T.LongType())] +
                          [T.StructField(f"_fg{i}", df.schema[c].dataType) for i, c in enumerate(g)] +
                          [T.StructField("_fstart", T.LongType())])
    bound = df.sparkSession.createDataFrame(rows, schema)
    same = None
    for i, c in enumerate(g):
        e = F.col(c).eqNullSafe(F.col(f"_fg{i}"))
        same = e if same is None else (same & e)
    idx = (gi.join(F.broadcast(bound), "_pid")
           .withColumn(idx_col, (F.col("_gidx") - F.when(same, F.col("_fstart"))
                                 .otherwise(F.col("_lstart"))).cast("long"))
           .select(*names, *carry, idx_col))
    return _join_back(df, idx, names, idx_col)


def _bucket(seq: str, size: int) -> Column:
    return F.floor((F.col(seq) - 1) / size).cast("long")


def _spread(df: DataFrame, g) -> DataFrame:
    """Hash-partition on (group, bucket) explicitly.  A child already
    partitioned by the group alone would otherwise satisfy the window's
    (group, bucket) clustering and keep a hot group in one task.  No fixed
    count: AQE may coalesce whole hash partitions of small data."""
    return df.repartition(*g, "_bkt")


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def cumulative(df: DataFrame, group_by, order_col: str, specs, bucket_size: int = 4096) -> DataFrame:
    """Several running aggregates in one pass, each over the rows of the
    group with ``order <= order(row)``.

    ``specs``: iterable of (out_col, kind, value) with kind in sum / min /
    max (min and max work on structs, so ``min(struct(key, payload))`` is a
    running argmin; NULL values are ignored).  ``order_col`` is a unique
    integer per group, dense or not.  Rows are hash-partitioned on (group,
    bucket of ``bucket_size`` consecutive order values); windows run per
    (group, bucket) and a carry from earlier buckets completes the result, so
    no task holds more than one bucket of a group.
    """
    g = _cols(group_by)
    specs = [(o, k, v if isinstance(v, Column) else F.col(v)) for o, k, v in specs]
    b = df.withColumn("_bkt", _bucket(order_col, bucket_size))
    for i, (_, _, v) in enumerate(specs):
        b = b.withColumn(f"_v{i}", v)
    b = _spread(b, g)
    w_local = (Window.partitionBy(*g, "_bkt").orderBy(order_col)
               .rowsBetween(Window.unboundedPreceding, 0))
    local = b
    for i, (_, k, _) in enumerate(specs):
        local = local.withColumn(f"_l{i}", _AGG[k](f"_v{i}").over(w_local))
    per_bucket = b.groupBy(*g, "_bkt").agg(*[_AGG[k](f"_v{i}").alias(f"_b{i}")
                                           for i, (_, k, _) in enumerate(specs)])
    w_carry = (Window.partitionBy(*g).orderBy("_bkt")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = per_bucket.select(*g, "_bkt", *[_AGG[k](f"_b{i}").over(w_carry).alias(f"_c{i}")
                                            for i, (_, k, _) in enumerate(specs)])
    # null-safe: a NULL group key is a group like any other
    out = join_null_safe(local, carry, g + ["_bkt"], "left")
    tmp = ["_bkt"]
    for i, (o, k, _) in enumerate(specs):
        l, c = F.col(f"_l{i}"), F.col(f"_c{i}")
        if k == "sum":
            val = F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif k == "min":
            val = F.least(l, c)
        else:
            val = F.greatest(l, c)
        out = out.withColumn(o, val)
        tmp += [f"_v{i}", f"_l{i}", f"_c{i}"]
    return out.drop(*tmp)


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` in which a NULL key equals a NULL key; the keys
    of ``left`` stay."""
    keys = _cols(keys)
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                     *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = left.join(r, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_k{i}" for i in range(len(keys))])


def cumulative_min_by(df: DataFrame, group_by, seq_col: str, value, key,
                      out_col: str, bucket_size: int = 4096) -> DataFrame:
    """For every row: ``min_by(value, key)`` over all rows of its group with
    ``seq <= seq(row)``; ``key`` a (total-order) struct."""
    v = value if isinstance(value, Column) else F.col(value)
    k = key if isinstance(key, Column) else F.col(key)
    r = cumulative(df, group_by, seq_col, [("_cm", "min", F.struct(k.alias("k"), v.alias("v")))], bucket_size)
    return r.withColumn(out_col, F.col("_cm.v")).drop("_cm")


def cumulative_max(df: DataFrame, group_by, seq_col: str, value, out_col: str,
                   bucket_size: int = 4096) -> DataFrame:
    """Running max of ``value`` over rows with seq <= seq(row) in the group."""
    return cumulative(df, group_by, seq_col, [(out_col, "max", value)], bucket_size)


def cumulative_sum(df: DataFrame, group_by, order_col: str, value, out_col: str,
                   bucket_size: int = 4096) -> DataFrame:
    """Running sum of ``value`` over rows of the group with
    ``order <= order(row)``."""
    return cumulative(df, group_by, order_col, [(out_col, "sum", value)], bucket_size)


def with_halo(df: DataFrame, seq_col: str, width: int, bucket_size: int,
              group_by=None) -> DataFrame:
    """Assign ``_bkt`` by seq and copy the last ``width-1`` rows of every
    bucket into the next one (``_halo`` = true) so row frames of up to
    ``width`` rows are complete inside each (group, bucket).  One pass: a
    row in a bucket's tail explodes into itself and its halo copy (no union,
    so the upstream is computed once).  With ``group_by`` the rows are
    hash-partitioned on (group, bucket)."""
    bucket_size = max(bucket_size, width)
    b0 = _bucket(seq_col, bucket_size)
    tail = (F.col(seq_col) - 1) % bucket_size >= bucket_size - (width - 1)
    targets = F.when(tail, F.array(b0, b0 + 1)).otherwise(F.array(b0))
    out = (df.select("*", F.posexplode(targets).alias("_hk", "_bkt"))
           .withColumn("_halo", F.col("_hk") == 1).drop("_hk"))
    return _spread(out, _cols(group_by)) if group_by is not None else out


def sliding_frame(group_by, seq_col: str, start: int, end: int):
    """Row frame [start, end] relative to the current row inside (group,
    bucket) partitions produced by :func:`with_halo`."""
    return (Window.partitionBy(*_cols(group_by), "_bkt").orderBy(seq_col)
            .rowsBetween(start, end))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_bkt", "_halo")
