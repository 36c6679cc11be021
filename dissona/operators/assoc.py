"""Association rules between two items of a basket, and the baskets that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dissona.sources.scratch import stored

MIN_SUPPORT, MIN_CONFIDENCE, MAX_CARDINALITY, MIN_ITEMS, MIN_BASKETS, MAX_RELATED = 0.05, 0.85, 0.5, 2, 20, 32


def baskets(df: DataFrame, tid: Column, item: Column) -> DataFrame:
    """Distinct (tid, item), written once for all that is mined from them; nulls of either are no items."""
    rows = df.select(tid.alias("tid"), item.alias("item")).where("tid IS NOT NULL AND item IS NOT NULL")
    return _flat(stored(rows.groupBy("tid").agg(F.collect_set("item").alias("items")), "baskets"))


def _flat(whole: DataFrame) -> DataFrame:
    """(tid, item) of (tid, items), which it keeps at hand."""
    b = whole.select("tid", F.explode("items").alias("item"))
    b.whole = whole
    return b


def whole(b: DataFrame) -> DataFrame:
    """(tid, items) of baskets: one row a basket, so that what meets in a basket meets without a join."""
    if not hasattr(b, "whole"):
        b.whole = stored(b.groupBy("tid").agg(F.collect_list("item").alias("items")), "baskets")
    return b.whole


def without(b: DataFrame, stop: DataFrame) -> DataFrame:
    """Baskets without stop-listed items (column item); applied before mining and before the search for violations."""
    return b.join(stop.select("item"), "item", "left_anti")


def mining_base(b: DataFrame) -> DataFrame:
    """Baskets of at least MIN_ITEMS items."""
    return _flat(whole(b).where(F.size("items") >= MIN_ITEMS))


def frequent_pairs(b: DataFrame, support: float = MIN_SUPPORT) -> DataFrame:
    """(item_a, item_b, pair_count, a_count, b_count, n): unordered pairs in at least a share `support` of n baskets.

    Items below the support are dropped before the pairs are made. Fewer than MIN_BASKETS baskets: no pairs."""
    base = mining_base(b)
    n = base.whole.count()
    items = stored(base.groupBy("item").agg(F.count("*").alias("c")).where(F.col("c") >= support * n), "items")
    often = F.broadcast(items.agg(F.collect_list("item").alias("often")))  # at most 1 / support times the mean size of a basket
    kept = base.whole.crossJoin(often).select(F.array_intersect("items", "often").alias("m")).where("size(m) > 1")
    pairs = kept.select(F.explode("m").alias("item_a"), "m").select("item_a", F.explode("m").alias("item_b")).where("item_a < item_b")
    out = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("pair_count")).where((F.col("pair_count") >= support * n) & F.lit(n >= MIN_BASKETS))
    for side in ("a", "b"):
        out = out.join(items.select(F.col("item").alias(f"item_{side}"), F.col("c").alias(f"{side}_count")), f"item_{side}")
    return out.select("item_a", "item_b", "pair_count", "a_count", "b_count", F.lit(n).cast("long").alias("n"))


def rules(b: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, cardinality: float = MAX_CARDINALITY) -> DataFrame:
    """(lhs, rhs, support_count, lhs_count, confidence, transaction_count), both directions of each frequent pair."""
    p = frequent_pairs(b, support).where((F.col("a_count") <= cardinality * F.col("n")) & (F.col("b_count") <= cardinality * F.col("n")))
    one = p.select(F.col("item_a").alias("lhs"), F.col("item_b").alias("rhs"), F.col("pair_count").alias("support_count"), F.col("a_count").alias("lhs_count"), F.col("n").alias("transaction_count"))
    two = p.select(F.col("item_b").alias("lhs"), F.col("item_a").alias("rhs"), F.col("pair_count").alias("support_count"), F.col("b_count").alias("lhs_count"), F.col("n").alias("transaction_count"))
    out = one.unionAll(two).withColumn("confidence", F.col("support_count") / F.col("lhs_count"))
    return out.where(F.col("confidence") >= confidence).select("lhs", "rhs", "support_count", "lhs_count", F.round("confidence", 6).alias("confidence"), "transaction_count")


def _with_lhs(b: DataFrame, found: DataFrame) -> DataFrame:
    """found beside each basket that has its lhs: (tid, items, lhs, rhs, ...)."""
    return whole(b).select("tid", "items", F.explode("items").alias("lhs")).join(F.broadcast(found), "lhs")


def violations(b: DataFrame, found: DataFrame) -> DataFrame:
    """(tid, lhs, rhs, confidence, percent): baskets, of any size, with a rule's lhs and without its rhs."""
    lack = _with_lhs(b, found.select("lhs", "rhs", "confidence")).where("NOT array_contains(items, rhs)")
    return lack.select("tid", "lhs", "rhs", "confidence", F.round(100 * F.col("confidence")).cast("long").alias("percent"))


def supporters(b: DataFrame, found: DataFrame, most: int = MAX_RELATED) -> DataFrame:
    """(lhs, rhs, related array of the first `most` supporting baskets, related_capped).

    The ranks are limited in each task before the shuffle, so no more than `most` rows of a rule leave a task."""
    found = stored(found.select("lhs", "rhs"), "rules")
    both = _with_lhs(b, found).where("array_contains(items, rhs)").select("tid", "lhs", "rhs")
    first = both.withColumn("rn", F.row_number().over(Window.partitionBy("lhs", "rhs").orderBy("tid"))).where(F.col("rn") <= most)
    out = first.groupBy("lhs", "rhs").agg(F.sort_array(F.collect_list("tid")).alias("related")).join(both.groupBy("lhs", "rhs").agg(F.count("*").alias("m")), ["lhs", "rhs"])
    return out.select("lhs", "rhs", "related", (F.col("m") > most).alias("related_capped"))
