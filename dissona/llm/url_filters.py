"""URL filters: given rules first, then a tree of path templates for each host. DataFrame functions only.

Variable segments become wildcards by their form: numbers {n}, hexadecimal names {h}, other names with a digit {m}.
What is left is counted per host as a tree of three levels (first segment, second, the rest), with the pages that a
rule allows or blocks as labels. From the leaves up, a branch is merged with its siblings into * unless it has
SUPPORT pages and its labelled share of blocks differs from that of all its siblings together (two-sided test at
5 %). A template's purity is its share of blocked labels, smoothed by its host's, which is smoothed by that of all
hosts; templates of a purity of at least REJECT are blocked. Only counts by host and template are shuffled, after
partial aggregation; a host of many pages is a key of many templates, and joins on it can be split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.llm.shared import stored

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
SUPPORT, WEIGHT, REJECT, CHI2 = 5, 4.0, 0.8, 3.8416
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    found = []
    for r in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = r.partition("/")
        found.append(F.when(((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest)), F.lit(r)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def wildcard(s: Column) -> Column:
    """The form of a segment, or the segment itself."""
    return (
        F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?\z"), F.regexp_replace(s, "^[0-9]+", "{n}"))
        .when(s.rlike(r"^[0-9a-fA-F-]{8,}\z") & s.rlike("[0-9]"), F.lit("{h}"))
        .when(s.rlike("[0-9]"), F.lit("{m}"))
        .otherwise(s)
    )


def judged(pages: DataFrame, rules: dict[str, str] = RULES, key: str = "page_id", url: str = "url", reject: float = REJECT) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) of each row.

    Null URLs and those without :// have an empty host and path and are judged as pages of that host. Repeated rows
    count and come back once each. Without labels nothing is blocked but by rule. Other columns are not read."""
    host, path = host_and_path(F.col("u"))
    rows = pages.select(pages[key].alias("k"), pages[url].alias("u")).select("k", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else None
    rows = rows.withColumn("label", verdicts[F.col("rule")] if rules else F.lit(None).cast("string"))
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), wildcard)
    rows = rows.withColumn("s", segments).select(
        "k", "host", "path", "rule", "label", F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("t1"), F.coalesce(F.get("s", F.lit(1)), F.lit("")).alias("t2"),
        F.when(F.size("s") > 2, F.array_join(F.slice("s", F.lit(3), F.greatest(F.size("s") - 2, F.lit(0))), "/")).otherwise("").alias("t3"),
    )
    names = ["host", "t1", "t2", "t3"]
    leaves = stored(rows.groupBy(*names).agg(F.count("*").alias("n3"), F.count(F.when(F.col("label") == "allow", 1)).alias("a3"), F.count(F.when(F.col("label") == "block", 1)).alias("b3")), "leaves")
    tree = leaves
    for level in (2, 1, 0):  # sums of the branches above
        tree = tree.join(leaves.groupBy(*names[: level + 1]).agg(F.sum("n3").alias(f"n{level}"), F.sum("a3").alias(f"a{level}"), F.sum("b3").alias(f"b{level}")), names[: level + 1])

    def kept(level: int) -> Column:
        n, a, b = (F.col(f"{x}{level}").cast("double") for x in "nab")
        pa, pb = (F.col(f"{x}{level - 1}").cast("double") for x in "ab")
        d = b * (pa + pb) - pb * (a + b)
        return (n >= SUPPORT) & (d != 0) & (d * d >= CHI2 * pa * pb * (a + b))

    tree = tree.select(*names, "a0", "b0", "a3", "b3", *[F.when(kept(k), F.col(f"t{k}")).otherwise("*").alias(f"m{k}") for k in (1, 2, 3)])
    template = F.concat(F.lit("/"), F.array_join(F.filter(F.array("m1", "m2", "m3"), lambda s: s != ""), "/"))
    tree = tree.select(*names, "a0", "b0", "a3", "b3", template.alias("template"))
    all_ = leaves.agg(F.coalesce(F.sum("a3"), F.lit(0)).cast("double"), F.coalesce(F.sum("b3"), F.lit(0)).cast("double")).first()
    share = all_[1] / (all_[0] + all_[1]) if all_[0] + all_[1] else 0.0
    sums = tree.groupBy("host", "template").agg(F.sum("a3").alias("a"), F.sum("b3").alias("b"), F.max("a0").alias("a0"), F.max("b0").alias("b0"))
    base = (F.col("b0") + F.lit(WEIGHT) * F.lit(share)) / (F.col("a0") + F.col("b0") + F.lit(WEIGHT))
    pure = sums.select("host", "template", F.round((F.col("b") + F.lit(WEIGHT) * base) / (F.col("a") + F.col("b") + F.lit(WEIGHT)), 6).alias("purity"))
    named = tree.select(*names, "template").join(pure, ["host", "template"])
    out = rows.join(named, names)
    verdict = F.coalesce("label", F.when(F.col("purity") >= reject, F.lit("block")).otherwise("allow"))
    return out.select(F.col("k").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts),
labelled AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS label,
  list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE
    WHEN regexp_matches(s, '^[0-9]+(\.[A-Za-z0-9]+)?\z') THEN regexp_replace(s, '^[0-9]+', '{n}')
    WHEN regexp_matches(s, '^[0-9a-fA-F-]{8,}\z') AND regexp_matches(s, '[0-9]') THEN '{h}'
    WHEN regexp_matches(s, '[0-9]') THEN '{m}' ELSE s END) AS s FROM ruled),
segs AS (SELECT page_id, host, path, rule, label, coalesce(s[1], '') AS t1, coalesce(s[2], '') AS t2, CASE WHEN len(s) > 2 THEN array_to_string(s[3:], '/') ELSE '' END AS t3 FROM labelled),
leaves AS (SELECT host, t1, t2, t3, count(*) AS n3, count(*) FILTER (label = 'allow') AS a3, count(*) FILTER (label = 'block') AS b3 FROM segs GROUP BY ALL),
sums AS (SELECT *, sum(n3) OVER w2 AS n2, sum(a3) OVER w2 AS a2, sum(b3) OVER w2 AS b2, sum(n3) OVER w1 AS n1, sum(a3) OVER w1 AS a1, sum(b3) OVER w1 AS b1, sum(a3) OVER w0 AS a0, sum(b3) OVER w0 AS b0
  FROM leaves WINDOW w2 AS (PARTITION BY host, t1, t2), w1 AS (PARTITION BY host, t1), w0 AS (PARTITION BY host)),
merged AS (SELECT *,
  CASE WHEN n3 >= 5 AND b3 * (a2 + b2) <> b2 * (a3 + b3) AND (b3 * (a2 + b2) - b2 * (a3 + b3))::DOUBLE ^ 2 >= 3.8416::DOUBLE * a2 * b2 * (a3 + b3) THEN t3 ELSE '*' END AS m3,
  CASE WHEN n2 >= 5 AND b2 * (a1 + b1) <> b1 * (a2 + b2) AND (b2 * (a1 + b1) - b1 * (a2 + b2))::DOUBLE ^ 2 >= 3.8416::DOUBLE * a1 * b1 * (a2 + b2) THEN t2 ELSE '*' END AS m2,
  CASE WHEN n1 >= 5 AND b1 * (a0 + b0) <> b0 * (a1 + b1) AND (b1 * (a0 + b0) - b0 * (a1 + b1))::DOUBLE ^ 2 >= 3.8416::DOUBLE * a0 * b0 * (a1 + b1) THEN t1 ELSE '*' END AS m1 FROM sums),
named AS (SELECT *, '/' || array_to_string(list_filter([m1, m2, m3], lambda s: s <> ''), '/') AS template FROM merged),
total AS (SELECT coalesce(sum(b3)::DOUBLE / nullif(sum(a3) + sum(b3), 0), 0) AS share FROM leaves),
pure AS (SELECT host, template, round((sum(b3) + 4.0::DOUBLE * ((max(b0) + 4.0::DOUBLE * max(share)) / (max(a0) + max(b0) + 4.0::DOUBLE))) / (sum(a3) + sum(b3) + 4.0::DOUBLE), 6) AS purity FROM named, total GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM segs JOIN named USING (host, t1, t2, t3) JOIN pure USING (host, template)
"""
