"""Calls whose two arguments stand in the order of the other parameter, and contradictory tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_LEAST = 3


def name_matches(a: Column, b: Column) -> Column:
    """Equal, or of other byte lengths where the shorter, of at least PREFIX_LEAST bytes, begins the longer."""
    la, lb = F.octet_length(a), F.octet_length(b)
    return (a == b) | ((la != lb) & (F.least(la, lb) >= PREFIX_LEAST) & F.when(la < lb, F.startswith(b, a)).otherwise(F.startswith(a, b)))


def correlation(a1: Column, a2: Column, p1: Column, p2: Column) -> tuple[Column, Column]:
    """(swapped, identity) of arguments and parameters."""
    return name_matches(a1, p2) & name_matches(a2, p1), name_matches(a1, p1) & name_matches(a2, p2)


def unique_defs(defs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p1, p2) of the names with exactly one definition; names in lower case."""
    g = defs.groupBy(*keys).agg(F.count("*").alias("n"), F.first("p1").alias("p1"), F.first("p2").alias("p2")).where("n = 1")
    return g.select(*keys, F.lower("p1").alias("p1"), F.lower("p2").alias("p2"))


def swapped_calls(defs: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """calls (keys, a1, a2, ...) with p1, p2 and match_kind ('strict' or 'prefix') where they are swapped and not in order."""
    j = calls.join(unique_defs(defs, keys), keys)
    a1, a2 = F.lower("a1"), F.lower("a2")
    swapped, same = correlation(a1, a2, F.col("p1"), F.col("p2"))
    kind = F.when((a1 == F.col("p2")) & (a2 == F.col("p1")), "strict").otherwise("prefix")
    return j.where(swapped & ~same).withColumn("match_kind", kind)


def uncorrelated_calls(defs: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls of unique definitions whose arguments have no relation to the parameters: candidates for a closer look."""
    j = calls.join(unique_defs(defs, keys), keys)
    swapped, same = correlation(F.lower("a1"), F.lower("a2"), F.col("p1"), F.col("p2"))
    return j.where(~swapped & ~same)


def conflict(positive: Column, negative: Column) -> Column:
    """The smallest tag that is asked for and excluded, else null."""
    return F.array_min(F.array_intersect(positive, negative))


def tag_sets(expression: Column) -> tuple[Column, Column]:
    """(positive, negative) tags of a build expression of names, !, && and parentheses: an odd number of ! excludes.

    Expressions with ||, with !( or with other characters are indeterminate: both null."""
    fine = ~expression.contains("||") & ~expression.rlike(r"!\s*\(") & expression.rlike(r"^[\w.!&()\s]*\z")
    terms = F.transform(F.regexp_extract_all(expression, F.lit(r"(!*\s*[\w.]+)"), 1), lambda t: F.struct((F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).alias("n"), F.regexp_replace(t, r"[!\s]", "").alias("tag")))
    side = lambda odd: F.when(fine, F.transform(F.filter(terms, lambda t: t["n"] % 2 == odd), lambda t: t["tag"]))
    return side(0), side(1)


def contradictory_flags(df: DataFrame, item: str, flag: str, order: str, one: str, other: str) -> DataFrame:
    """(item, first_one, first_other, additional_pairs): items that carry both flags; the first pair is told, the rest counted."""
    is_one, is_other = F.col(flag) == one, F.col(flag) == other
    g = df.groupBy(item).agg(F.min(F.when(is_one, F.col(order))).alias("first_one"), F.min(F.when(is_other, F.col(order))).alias("first_other"), F.count(F.when(is_one, 1)).alias("n1"), F.count(F.when(is_other, 1)).alias("n2"))
    return g.where("n1 > 0 AND n2 > 0").select(item, "first_one", "first_other", (F.col("n1") * F.col("n2") - 1).alias("additional_pairs"))
