"""Handlers that an earlier one of their list covers, over a class hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissona.sources.scratch import stored


def ancestors(parents: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """(name, ancestor, depth) of every class, itself included at depth 0.

    parents, local: (name, parent); local rows replace those of the same name. Cycles end; a name without a row is its
    own only ancestor and so not listed. A round joins one level, on the new pairs alone."""
    if local is not None:
        parents = parents.join(local.select("name").distinct(), "name", "left_anti").unionByName(local)
    parents = parents.select("name", "parent")
    names = parents.select("name").unionAll(parents.where("parent IS NOT NULL").select(F.col("parent").alias("name"))).distinct()
    found = names.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("depth"))
    new = found
    depth = 0
    while True:  # ends when a round finds no new pair, on cycles too
        depth += 1
        up = new.join(parents.select(F.col("name").alias("ancestor"), "parent"), "ancestor").where("parent IS NOT NULL").select("name", F.col("parent").alias("ancestor")).distinct()
        new = stored(up.join(found, ["name", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "ancestors")
        if new.isEmpty():
            break
        found = found.unionAll(new)
    return found


def shadowed(handlers: DataFrame, closure: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """(try_id, ord, by_ord): handlers each of whose types an earlier handler of the try covers; by_ord is the first such.

    handlers: (try_id, ord, type), a row for each type of a tuple. roots cover every type. Unknown types are covered
    by themselves and the roots only. All joins are on equal (try_id, type)."""
    up = handlers.join(closure.select(F.col("name").alias("type"), "ancestor"), "type", "left").select("try_id", "ord", "type", F.coalesce("ancestor", "type").alias("cover"))
    if roots:
        top = handlers.select("try_id", "ord", "type", F.explode(F.array(*map(F.lit, roots))).alias("cover"))
        up = up.unionAll(top).distinct()
    first = handlers.groupBy("try_id", F.col("type").alias("cover")).agg(F.min("ord").alias("at"))
    met = up.join(first, ["try_id", "cover"], "left").groupBy("try_id", "ord", "type").agg(F.min(F.when(F.col("at") < F.col("ord"), F.col("at"))).alias("at"))
    out = met.groupBy("try_id", "ord").agg(F.count("*").alias("n"), F.count("at").alias("covered"), F.min("at").alias("by_ord"))
    return out.where("n = covered").select("try_id", "ord", "by_ord")
