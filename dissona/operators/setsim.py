"""Set similarity of token shingles: pairs over a threshold, groups, and the drifted member of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.operators import setjoin
from dissona.operators.components import components
from dissona.sources.scratch import stored

NGRAM, MIN_TOKENS, SIMILARITY, MIN_GROUP = 3, 22, 0.5, 3
NEAR_DUPLICATE, LENGTH_IMBALANCE, LENGTH_FLOOR, LENGTH_BUFFER = 0.7, 0.15, 3, 2


def word_tokens(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.filter(F.split(text, r"[\t-\r ]+"), lambda t: t != "")


def shingles(tokens: Column, n: int = NGRAM) -> Column:
    """Distinct n-token shingles as 64-bit hashes; fewer than n tokens: none."""
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)])))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def prepare(df: DataFrame, key: str, tokens: Column, scope: Column | None = None, least: int = MIN_TOKENS) -> DataFrame:
    """(id, scope, n_tokens, s): members of at least `least` tokens with their shingle sets, written once."""
    t = df.select(F.col(key).alias("id"), (scope if scope is not None else F.lit("")).alias("scope"), tokens.alias("t")).where(F.size("t") >= least)
    return stored(t.select("id", "scope", F.size("t").alias("n_tokens"), shingles(F.col("t")).alias("s")), "shingles")


def pairs(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, j): pairs a < b of one scope with a Jaccard similarity of at least `similarity`; exact.

    Equal sets of a scope are one class, of which setjoin compares the first; its pairs are then written out for all
    members. So a class of copies costs no more than the rows it gives."""
    members = members.where(F.size("s") > 0)
    first, copies, total = setjoin.classes(members)
    found = setjoin.alike(first, total, similarity)
    spread = F.broadcast if (n := copies.count()) <= setjoin.BROADCAST else lambda t: t
    if not n:
        return found
    own = copies.select(F.col("first").alias("of"), "id").unionAll(copies.select(F.col("first").alias("of"), F.col("first").alias("id")).distinct())
    for side in ("a", "b"):
        also = own.select(F.col("of").alias(side), F.col("id").alias("to"))
        found = found.join(spread(also), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    salts = 16  # a large class is dealt over as many tasks
    x = own.select("of", "id", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).repartition(min(2000, n // 2000 + 1), "of", "salt")
    y = own.select("of", F.col("id").alias("other"))
    met = x.join(spread(y), "of") if n <= setjoin.BROADCAST else x.join(y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))), ["of", "salt"])
    same = met.where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), F.lit(1.0).alias("j"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "j").unionAll(same)


def linked(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): enough pairs over `similarity` to join what they join. Equal sets of a scope are one class: its members
    are tied to its first, and only the first ones are compared, so copies never make pairs with each other."""
    first, copies, total = setjoin.classes(members)
    return setjoin.ties(first.where(F.size("s") > 0), total, similarity).unionAll(copies.select(F.col("id").alias("a"), F.col("first").alias("b")))


def groups(linked: DataFrame) -> DataFrame:
    """(id, component) of the members of pairs (a, b)."""
    return components(linked.select("a", "b"))


def drift(members: DataFrame, grouped: DataFrame, forms: DataFrame) -> DataFrame:
    """(group_id, drifted, exemplar, group_size, majority, j): the one member that left a group of copies.

    forms: (id, form), equal for identical members. Gates in order: a group of MIN_GROUP; a strict majority of one
    form, of at least two members; fewer than two forms of one member each; not three members of little more than the
    least length; exactly one such form; its similarity to the majority's first member at least NEAR_DUPLICATE; and,
    for a majority below LENGTH_FLOOR, lengths within LENGTH_IMBALANCE."""
    m = grouped.join(forms, "id").join(members.select("id", "n_tokens"), "id")
    parts = m.groupBy("component", "form").agg(F.count("*").alias("c"), F.min("id").alias("first"), F.min_by("n_tokens", "id").alias("len"))
    g = parts.groupBy("component").agg(
        F.sum("c").alias("size"), F.max(F.struct("c", (-F.col("first")).alias("neg"), "len")).alias("top"),
        F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("singles"), F.min(F.when(F.col("c") == 1, F.struct("first", "len"))).alias("odd"),
    )
    g = g.where((F.col("size") >= MIN_GROUP) & (2 * F.col("top.c") > F.col("size")) & (F.col("top.c") >= 2) & (F.col("singles") == 1))
    g = g.where(~((F.col("size") == 3) & (F.col("top.len") <= MIN_TOKENS + LENGTH_BUFFER)))
    g = g.select(F.col("component").alias("group_id"), F.col("odd.first").alias("drifted"), (-F.col("top.neg")).alias("exemplar"), F.col("size").cast("long").alias("group_size"), F.col("top.c").alias("majority"), F.col("odd.len").alias("la"), F.col("top.len").alias("lb"))
    g = g.where((F.col("majority") >= LENGTH_FLOOR) | (F.abs(F.col("la") - F.col("lb")) / F.greatest("la", "lb") <= LENGTH_IMBALANCE))
    g = stored(g, "drifted")
    wanted = g.select(F.col("drifted").alias("id")).unionAll(g.select(F.col("exemplar").alias("id"))).distinct()
    few = wanted.count() <= setjoin.BROADCAST  # the sets of all others are not moved
    m = stored(members.select("id", "s").join(F.broadcast(wanted) if few else wanted, "id", "left_semi"), "wanted")
    sa, sb = m.select(F.col("id").alias("drifted"), F.col("s").alias("sa")), m.select(F.col("id").alias("exemplar"), F.col("s").alias("sb"))
    out = g.join(sa, "drifted").join(sb, "exemplar").withColumn("j", jaccard(F.col("sa"), F.col("sb"))).where(F.col("j") >= NEAR_DUPLICATE)
    return out.select("group_id", "drifted", "exemplar", "group_size", "majority", F.round("j", 6).alias("j"))


def normalised_source(text: Column, hash_comments: bool = False) -> Column:
    """Comments taken out without regard to strings, white space collapsed and trimmed."""
    t = F.regexp_replace(text, r"#[^\n]*", "") if hash_comments else F.regexp_replace(F.regexp_replace(text, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return F.trim(F.regexp_replace(t, r"[\t-\r ]+", " "))


def identical_forms(df: DataFrame, key: str, text: Column, least: int = MIN_TOKENS) -> DataFrame:
    """(form, n, first_id): normalised sources of at least `least` words that several rows share."""
    t = df.select(F.col(key).alias("id"), normalised_source(text).alias("t")).where(F.size(word_tokens(F.col("t"))) >= least)
    return t.groupBy(F.md5("t").alias("form")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def shared_prefix(met: DataFrame, texts: DataFrame, least_bytes: int = 20) -> DataFrame:
    """(a, b, shared_lines, shared_bytes): pairs whose first lines are equal, of at least so many bytes, and that differ later.

    Lines are compared by their 64-bit hashes; pairs of equal texts or of unequal first lines go before lines are joined."""
    lines = F.split("text", "\n")
    t = texts.where("text IS NOT NULL").select("id", F.struct(F.octet_length("text"), F.xxhash64("text")).alias("all"), F.transform(lines, lambda x: F.xxhash64(x)).alias("l"), F.transform(lines, F.octet_length).alias("size"))
    t = stored(t.withColumn("one", F.get("l", F.lit(0))), "lines")
    for side in ("a", "b"):
        met = met.select("a", "b", *([] if side == "a" else ["alla", "onea"])).join(t.select(F.col("id").alias(side), F.col("all").alias("all" + side), F.col("one").alias("one" + side)), side)
    met = met.where("onea = oneb AND alla != allb").select("a", "b")
    la, lb = t.select(F.col("id").alias("a"), F.col("l").alias("la"), "size"), t.select(F.col("id").alias("b"), F.col("l").alias("lb"))
    eq = F.zip_with("la", "lb", lambda x, y: F.coalesce(x == y, F.lit(False)))
    out = met.join(la, "a").join(lb, "b").withColumn("k", F.array_position(eq, F.lit(False)) - 1)
    size = F.aggregate(F.slice("size", F.lit(1), F.greatest(F.col("k"), F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda n, x: n + x)
    return out.select("a", "b", F.col("k").alias("shared_lines"), size.alias("shared_bytes")).where((F.col("shared_lines") >= 1) & (F.col("shared_bytes") >= least_bytes))
