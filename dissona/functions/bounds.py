"""Lower bounds of a share of hits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z, TAIL, SMALL_SAMPLE, BISECTIONS = 1.96, 0.025, 30, 100


def posterior(tp: Column, fp: Column) -> Column:
    return (tp + 1) / (tp + fp + 2)


def wilson_lower(tp: Column, fp: Column) -> Column:
    """Lower end of Wilson's 95 % interval; no rows: 0."""
    n = (tp + fp).cast("double")
    p = tp / n
    low = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(low, F.lit(0.0)))


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function for whole a, b: the chance of at least a hits among a + b - 1."""
    n = (a + b - 1).cast("int")
    # terms from n hits downwards: C(n, k) x^k (1 - x)^(n - k), the binomial coefficient built up on the way
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("c"))
    step = lambda s, k: F.struct((s["sum"] + s["c"] * F.pow(x, k) * F.pow(1 - x, n - k)).alias("sum"), (s["c"] * k / (n - k + 1)).alias("c"))
    return F.aggregate(F.sequence(n, a.cast("int"), F.lit(-1)), start, step, lambda s: s["sum"])


def jeffreys_lower(tp: Column, fp: Column) -> Column:
    """2.5 % quantile of Beta(tp + 1, fp + 1) by bisection; no hits: 0. For small counts only (see `lower_bound`)."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = beta_cdf(mid, tp + 1, fp + 1) < TAIL
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(tp == 0, 0.0).otherwise(found)


def lower_bound(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp < SMALL_SAMPLE, jeffreys_lower(tp, fp)).otherwise(wilson_lower(tp, fp))


def bound_method(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp < SMALL_SAMPLE, "jeffreys").otherwise("wilson")


def rank_score(lower: Column, related: Column) -> Column:
    """Calibrated findings: bound times 1 + log2(1 + related); others: the number of related places."""
    return F.when(lower.isNotNull(), lower * (1 + F.log2(1 + related))).otherwise(related.cast("double"))


def sigmoid_clamped(raw: Column, a: Column, b: Column) -> Column:
    """Platt's map of a confidence, clamped to 0..1 first."""
    return 1 / (1 + F.exp(-(a * F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) + b)))
