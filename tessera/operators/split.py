"""Seeded train / validation split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.index import with_global_index

# --- fixed values (must equal the reference for equal results) -------------
TRAIN_FRACTION = 0.9
SPLIT_SEED = 42
# ---------------------------------------------------------------------------


def hash_bound(frac: float) -> str:
    """Hex bound so that ``md5 prefix (8 hex) < bound`` has probability frac."""
    if not 0.0 <= frac <= 1.0:
        raise ValueError("frac must be in [0, 1]")
    v = int(frac * (1 << 32))
    return "g" if v >= (1 << 32) else format(v, "08x")


def split_hash(key_col, seed: int):
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string"))), 1, 8)


def split_train_val(df: DataFrame, key_col: str, frac: float = TRAIN_FRACTION,
                    seed: int = SPLIT_SEED, exact: bool = False,
                    out: str = "split") -> DataFrame:
    """Seeded, stable, disjoint and exhaustive split (split_train_val).

    Default: a row is 'train' when the first 8 hex digits of
    md5('<seed>:<key>') sort below the bound of ``frac`` - no shuffle, stable
    under appends.  ``exact=True``: rank rows by that hash (key breaks ties)
    with the skew-safe global index and take exactly floor(frac * n).
    """
    h = split_hash(key_col, seed)
    if not exact:
        return df.withColumn(out, F.when(h < F.lit(hash_bound(frac)), F.lit("train"))
                             .otherwise(F.lit("validation")))
    ranked = with_global_index(df.withColumn("_h", h), ["_h", key_col], "_r")
    n_train = int(frac * df.count())
    return (ranked.withColumn(out, F.when(F.col("_r") < n_train, F.lit("train"))
                              .otherwise(F.lit("validation"))).drop("_h", "_r"))
