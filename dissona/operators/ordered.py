"""Operators over ordered rows that need no window: first terminators, suppression by intervals, counted ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_terminator(df: DataFrame, block: list[str], order: list[str], stop: Column, location: str) -> DataFrame:
    """(block, terminator, next_location, n_after): what follows the first terminator of each block.

    Blocks without one, or where it stands last, give no row. Two aggregations with partial sums and one join, so a
    long block is never sorted in one task."""
    place = F.struct(*order, F.col(location).alias("__location"))
    first = df.where(stop).groupBy(*block).agg(F.min(place).alias("t"))
    after = df.join(first, block).where(place > F.col("t"))
    return after.groupBy(*block).agg(F.first("t").getField("__location").alias("terminator"), F.min(place).getField("__location").alias("next_location"), F.count("*").alias("n_after"))


def suppressed(points: DataFrame, intervals: DataFrame, equal: list[str], at: str, lo: str, hi: str, width: float, ids: str | None = None, name: str | None = None) -> DataFrame:
    """points without those that an interval covers: equal columns, lo <= at <= hi, and, where the interval lists ids
    (array; null: all), the point's name among them.

    Both sides are cut into buckets of `width`, so the join is an equality join even for one hot key."""
    number = lambda c: F.floor(F.col(c).cast("double") / width)
    cut = intervals.select(*[F.col(c).alias(f"i_{c}") for c in equal], F.col(lo).alias("i_lo"), F.col(hi).alias("i_hi"), (F.col(ids) if ids else F.lit(None).cast("array<string>")).alias("i_ids"), F.explode(F.sequence(number(lo), number(hi))).alias("i_k"))
    on = F.col("k") == F.col("i_k")
    for c in equal:
        on &= F.col(c) == F.col(f"i_{c}")
    on &= F.col(at).between(F.col("i_lo"), F.col("i_hi"))
    if ids:
        on &= F.col("i_ids").isNull() | F.array_contains("i_ids", F.col(name))
    return points.withColumn("k", number(at)).join(cut, on, "left_anti").drop("k")


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str = "rn") -> DataFrame:
    """df with the number of each row among those of its keys, by order, from 1.

    bucket grows with the order. Rows are numbered inside (keys, bucket), after the rows of earlier buckets, whose
    numbers are summed over a small table, so a key that holds most rows is spread over its buckets."""
    from pyspark.sql import Window as W

    cut = df.withColumn("__k", bucket)
    sizes = cut.groupBy(*keys, "__k").agg(F.count("*").alias("__m"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__m").over(W.partitionBy(*keys).orderBy("__k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__m")
    inside = F.row_number().over(W.partitionBy(*keys, "__k").orderBy(*order))
    return cut.join(before, [*keys, "__k"]).withColumn(name, F.col("__b") + inside).drop("__k", "__b")


def last_known(df: DataFrame, key: str, order: list[str], value: Column, name: str, bucket: Column) -> DataFrame:
    """df with the last value that is not null up to each row of its key.

    bucket grows with the order: a key's rows are ordered inside its buckets, and the last value of the buckets before
    is carried over a table of one row a bucket."""
    from pyspark.sql import Window as W

    cut = df.withColumn("__v", value).withColumn("__k", bucket)
    ends = cut.where("__v IS NOT NULL").groupBy(key, "__k").agg(F.max_by("__v", F.struct(*order)).alias("__e"))
    every = cut.select(key, "__k").distinct().join(ends, [key, "__k"], "left")
    carried = every.withColumn("__c", F.last("__e", ignorenulls=True).over(W.partitionBy(key).orderBy("__k").rowsBetween(W.unboundedPreceding, -1))).select(F.col(key).alias("__key"), F.col("__k").alias("__b"), "__c")
    inside = F.last("__v", ignorenulls=True).over(W.partitionBy(key, "__k").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    met = cut.withColumn("__i", inside).join(carried, F.col(key).eqNullSafe(F.col("__key")) & F.col("__k").eqNullSafe(F.col("__b")), "left")
    return met.withColumn(name, F.coalesce("__i", "__c")).drop("__v", "__k", "__i", "__key", "__b", "__c")


def debounced(df: DataFrame, key: str, ts: str, gap: str, value: str, order: list[str]) -> DataFrame:
    """(key, session_start, n, latest): of events less than `gap` apart, the latest value."""
    g = df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max_by(value, F.struct(*order)).alias("latest"))
    return g.select(key, F.col("w.start").alias("session_start"), "n", "latest")
