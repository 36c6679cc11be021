"""Bags of findings: matching with expectations, baselines, deltas of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.operators.ordered import numbered

BASELINE_VERSION = 1


def matched(actual: DataFrame, expected: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """(group, tp, fp, fn): one-to-one matching of equal keys is min and difference of their counts (INTERSECT ALL)."""
    a = actual.groupBy(*keys).agg(F.count("*").alias("a"))
    e = expected.groupBy(*keys).agg(F.count("*").alias("e"))
    j = a.join(e, keys, "full_outer").na.fill(0, ["a", "e"])
    return j.groupBy(*group).agg(F.sum(F.least("a", "e")).alias("tp"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("fn"))


def scores(m: DataFrame, group: str, overall: str | None = "overall") -> DataFrame:
    """Precision, recall and F1 of each group, 0 where undefined, and of the sums of all groups."""
    if overall is not None:
        m = m.unionByName(m.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]).withColumn(group, F.lit(overall)))
    ratio = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    m = m.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return m.withColumn("f1", f1).select(group, "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall")], F.round("f1", 6).alias("f1"))


def baseline(findings: DataFrame, fingerprint: list[str]) -> DataFrame:
    """(fingerprint, count): what later runs may repeat."""
    return findings.groupBy(*fingerprint).agg(F.count("*").alias("count"))


def beyond_baseline(findings: DataFrame, budget: DataFrame, fingerprint: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """Findings after the first `count` of their fingerprint in rank order (a counted anti-join)."""
    ranked = numbered(findings, fingerprint, bucket, order)
    return ranked.join(budget.select(*fingerprint, "count"), fingerprint, "left").where(F.col("rn") > F.coalesce("count", F.lit(0))).drop("count", "rn")


def delta(current: DataFrame, previous: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Metrics now (0 where the key is gone), before (null where it is new) and their difference."""
    c = current.select(key, *[F.col(m).alias(f"{m}_now") for m in metrics])
    p = previous.select(key, *[F.col(m).alias(f"{m}_before") for m in metrics])
    j = c.join(p, key, "full_outer")
    out = [F.col(key)]
    for m in metrics:
        now = F.coalesce(f"{m}_now", F.lit(0.0))
        out += [now.alias(f"{m}_now"), F.col(f"{m}_before"), F.round(now - F.col(f"{m}_before"), 6).alias(f"{m}_delta")]
    return j.select(*out)


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All detectors' findings in one table, by column names."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
