"""Array / probability helpers, evaluated by the JVM (no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _dbl(col) -> Column:
    return F.transform(_c(col), lambda x: x.cast("double"))


def log_softmax(col) -> Column:
    """x - logsumexp(x) per row (vec_log_softmax).

    One ``aggregate`` pass keeps a running (max, sum of exp(x - max)) - the
    online, overflow-safe log-sum-exp - and its finish step subtracts the
    result from every element.  Row scalars are bound once as lambda
    variables, so the cost is O(n) per row (an outer expression referenced
    inside ``transform`` would be re-evaluated for every element).
    """
    x = _dbl(col)
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def merge(acc, v):
        m2 = F.greatest(acc["m"], v)
        s2 = acc["s"] * F.exp(acc["m"] - m2) + F.exp(v - m2)
        # -inf so far (masked values): nothing to add up, and -inf - -inf is NaN
        return F.struct(m2.alias("m"), F.when(m2 == float("-inf"), F.lit(0.0)).when(
            acc["m"] == float("-inf"), F.lit(1.0)).otherwise(s2).alias("s"))

    return F.aggregate(x, init, merge,
                       lambda acc: F.transform(x, lambda v: v - (acc["m"] + F.log(acc["s"]))))


def l2_norm(col) -> Column:
    return F.sqrt(F.aggregate(_dbl(col), F.lit(0.0), lambda acc, v: acc + v * v))


def l2_normalize(col, eps: float = 1e-12) -> Column:
    """Divide by the L2 norm clamped at ``eps``; a zero vector stays zero.
    The norm is bound once per row in the aggregate's finish step."""
    x = _dbl(col)
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v,
                       lambda ss: F.transform(x, lambda v: v / F.greatest(F.sqrt(ss), F.lit(eps))))


def last_state(col) -> Column:
    """Last position of a sequence (vec_last)."""
    return F.element_at(_c(col), -1)


def kl_term_sum(base_lp, cand_lp) -> Column:
    """sum_v exp(b_v) * (b_v - c_v) for one prompt: KL(base || candidate).

    A term with base probability 0 (b = -inf) counts 0.  Vocabulary lengths
    must match; a mismatch fails the query instead of padding silently.
    """
    b, c = _c(base_lp), _c(cand_lp)
    terms = F.zip_with(b, c, lambda x, y: F.when(x == float("-inf"), F.lit(0.0))
                       .otherwise(F.exp(x) * (x - y)))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(F.size(b) == F.size(c), total).otherwise(
        F.raise_error(F.lit("kl_divergence: vocabulary sizes differ")).cast("double"))


def sub_arrays(a, b) -> Column:
    """Element-wise a - b."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)
