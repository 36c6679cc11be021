"""Driver queries over the shared tables: each kernel applied to plain relational or text data, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissona.functions import bounds, strings
from dissona.operators import agreement, assoc, bags, hierarchy, ordered, setsim, swaps
from dissona.plans import sinks
from dissona.plans.scan import scan
from dissona.sources.scratch import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "clone_drift"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- association rules

BASKETS = "b AS (SELECT DISTINCT l_orderkey AS tid, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
EVENTS = "b AS (SELECT DISTINCT user_id::VARCHAR || '/' || ts::DATE::VARCHAR AS tid, event_type AS item FROM events)"
MINED = """base AS (SELECT * FROM b WHERE tid IN (SELECT tid FROM b GROUP BY tid HAVING count(*) >= 2)),
total AS (SELECT count(DISTINCT tid) AS n FROM base), ones AS (SELECT item, count(*) AS c FROM base GROUP BY item),
pairs AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS pair_count FROM base x JOIN base y ON x.tid = y.tid AND x.item < y.item GROUP BY ALL),
freq AS (SELECT item_a, item_b, pair_count, a.c AS a_count, b.c AS b_count, n FROM pairs JOIN ones a ON a.item = item_a JOIN ones b ON b.item = item_b, total WHERE pair_count >= {s} * n AND n >= 20),
two AS (SELECT item_a AS lhs, item_b AS rhs, pair_count, a_count AS lhs_count, n FROM freq WHERE a_count <= {k} * n AND b_count <= {k} * n
  UNION ALL SELECT item_b, item_a, pair_count, b_count, n FROM freq WHERE a_count <= {k} * n AND b_count <= {k} * n),
rules AS (SELECT lhs, rhs, pair_count AS support_count, lhs_count, round(pair_count / lhs_count, 6) AS confidence, n AS transaction_count FROM two WHERE pair_count / lhs_count >= {c})"""


def order_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return assoc.baskets(j, F.col("l_orderkey"), F.col("p_type"))


def event_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.baskets(table(spark, sf_dir, "events"), F.concat_ws("/", "user_id", F.to_date("ts")), F.col("event_type"))


@query(f"WITH {BASKETS}, {MINED.format(s=0.05, c=0.5, k=0.9)} SELECT * FROM freq")
def frequent_pairs(spark, sf_dir):
    return assoc.frequent_pairs(order_baskets(spark, sf_dir), 0.05)


@query(f"WITH {BASKETS}, {MINED.format(s=0.05, c=0.5, k=0.9)} SELECT * FROM rules")
def association_rules(spark, sf_dir):
    return assoc.rules(order_baskets(spark, sf_dir), 0.05, 0.5, 0.9)


@query(f"WITH {EVENTS}, {MINED.format(s=0.01, c=0.2, k=0.9)} SELECT * FROM rules")
def association_rules_events(spark, sf_dir):
    return assoc.rules(event_baskets(spark, sf_dir), 0.01, 0.2, 0.9)


@query(f"WITH {BASKETS}, {MINED.format(s=0.05, c=0.5, k=0.9)} SELECT tid, lhs, rhs, confidence, round(100 * confidence)::BIGINT AS percent FROM b JOIN rules ON item = lhs WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.tid = b.tid AND o.item = rhs)")
def rule_violations(spark, sf_dir):
    b = order_baskets(spark, sf_dir)
    return assoc.violations(b, assoc.rules(b, 0.05, 0.5, 0.9))


@query(f"""WITH {BASKETS}, {MINED.format(s=0.05, c=0.5, k=0.9)}, s AS (SELECT lhs, rhs, x.tid FROM rules JOIN b x ON x.item = lhs JOIN b y ON y.item = rhs AND y.tid = x.tid)
SELECT lhs, rhs, array_to_string(list_sort(list(tid))[1:32], ',') AS related, count(*) > 32 AS related_capped FROM s GROUP BY lhs, rhs""")
def rule_supporters(spark, sf_dir):
    b = order_baskets(spark, sf_dir)
    return assoc.supporters(b, assoc.rules(b, 0.05, 0.5, 0.9)).withColumn("related", F.array_join(F.transform("related", lambda x: x.cast("string")), ","))


# -- set similarity

SHINGLED = r"""toks AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\t-\r ]+'), lambda t: t <> '') AS t FROM documents),
members AS (SELECT doc_id AS id, text, len(t) AS n_tokens, t FROM toks WHERE len(t) >= 22),
sh AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM members),
sz AS (SELECT id, count(*) AS n FROM sh GROUP BY id), cm AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
prs AS (SELECT a, b, c / (p.n + q.n - c) AS j FROM cm JOIN sz p ON p.id = a JOIN sz q ON q.id = b WHERE c / (p.n + q.n - c) >= 0.5),
sym AS (SELECT a, b FROM prs UNION ALL SELECT b, a FROM prs),
reach AS (SELECT a AS id, a AS r FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.r), grp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""


def doc_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return docs, setsim.prepare(docs, "doc_id", setsim.word_tokens(F.col("text")))


@query(f"WITH {SHINGLED.split('sym AS')[0].rstrip().rstrip(',')} SELECT a, b, round(j, 6) AS j FROM prs")
def clone_pairs(spark, sf_dir):
    return setsim.pairs(doc_members(spark, sf_dir)[1]).select("a", "b", F.round("j", 6).alias("j"))


@query(f"WITH RECURSIVE {SHINGLED} SELECT id, component FROM grp")
def clone_groups(spark, sf_dir):
    return setsim.groups(setsim.linked(doc_members(spark, sf_dir)[1]))


@query(f"""WITH RECURSIVE {SHINGLED}, m AS (SELECT component, g.id, md5(text) AS form, n_tokens FROM grp g JOIN members USING (id)),
parts AS (SELECT component, form, count(*) AS c, min(id) AS first, arg_min(n_tokens, id) AS len FROM m GROUP BY ALL),
tops AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY c DESC, first) AS k, sum(c) OVER (PARTITION BY component) AS size, count(*) FILTER (c = 1) OVER (PARTITION BY component) AS singles FROM parts),
g AS (SELECT t.component AS group_id, o.first AS drifted, t.first AS exemplar, t.size::BIGINT AS group_size, t.c AS majority, o.len AS la, t.len AS lb FROM tops t JOIN parts o ON o.component = t.component AND o.c = 1
  WHERE t.k = 1 AND t.size >= 3 AND 2 * t.c > t.size AND t.c >= 2 AND t.singles = 1 AND NOT (t.size = 3 AND t.len <= 24))
SELECT group_id, drifted, exemplar, group_size, majority, round(j, 6) AS j FROM g JOIN prs ON a = least(drifted, exemplar) AND b = greatest(drifted, exemplar)
WHERE j >= 0.7 AND (majority >= 3 OR abs(la - lb) / greatest(la, lb) <= 0.15)""")
def clone_drift(spark, sf_dir):
    docs, members = doc_members(spark, sf_dir)
    return setsim.drift(members, setsim.groups(setsim.linked(members)), docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("form")))


NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '//[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '[\t-\r ]+', ' ', 'g'))"


@query(f"WITH t AS (SELECT doc_id, {NORMAL} AS t FROM documents) SELECT md5(t) AS form, count(*) AS n, min(doc_id) AS first_id FROM t WHERE len(list_filter(string_split(t, ' '), lambda w: w <> '')) >= 22 GROUP BY t HAVING count(*) > 1")
def branch_identical(spark, sf_dir):
    return setsim.identical_forms(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query(f"""WITH {SHINGLED.split('sym AS')[0].rstrip().rstrip(',')}, l AS (SELECT prs.a, prs.b, string_split(x.text, chr(10)) AS la, string_split(y.text, chr(10)) AS lb FROM prs JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b),
k AS (SELECT a, b, la, list_position(list_transform(range(1, greatest(len(la), len(lb)) + 1), lambda i: coalesce(la[i] = lb[i], false)), false) - 1 AS k FROM l)
SELECT a, b, k::BIGINT AS shared_lines, list_sum(list_transform(la[1:k], lambda s: strlen(s)))::BIGINT AS shared_bytes FROM k WHERE k >= 1 AND list_sum(list_transform(la[1:k], lambda s: strlen(s))) >= 20""")
def branch_shared_prefix(spark, sf_dir):
    docs, members = doc_members(spark, sf_dir)
    return setsim.shared_prefix(setsim.pairs(members), docs.select(F.col("doc_id").alias("id"), "text"))


# -- swapped arguments, tags, flags

CALLS = """d AS (SELECT p_partkey AS name, lower(split_part(p_name, ' ', 1)) AS p1, lower(split_part(p_name, ' ', 2)) AS p2 FROM part),
defs AS (SELECT * FROM d WHERE name % 11 <> 0),
calls AS (SELECT name, CASE WHEN name % 14 = 0 THEN substr(p2, 1, 4) WHEN name % 7 = 0 THEN p2 ELSE p1 END AS a1, CASE WHEN name % 14 = 0 THEN substr(p1, 1, 4) WHEN name % 7 = 0 THEN p1 WHEN name % 5 = 0 THEN 'other' ELSE p2 END AS a2 FROM d),
j AS (SELECT * FROM calls JOIN defs USING (name))"""


def _match(a: str, b: str) -> str:
    return f"({a} = {b} OR (strlen({a}) <> strlen({b}) AND least(strlen({a}), strlen({b})) >= 3 AND CASE WHEN strlen({a}) < strlen({b}) THEN starts_with({b}, {a}) ELSE starts_with({a}, {b}) END))"


SWAPPED, SAME = f"({_match('a1', 'p2')} AND {_match('a2', 'p1')})", f"({_match('a1', 'p1')} AND {_match('a2', 'p2')})"


def part_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Definitions from part names (every eleventh twice, so that it is ambiguous) and calls, some of them perturbed."""
    w = F.split("p_name", " ")
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.get(w, F.lit(0)).alias("p1"), F.get(w, F.lit(1)).alias("p2"))
    k = F.col("name")
    a1 = F.when(k % 14 == 0, F.substring("p2", 1, 4)).when(k % 7 == 0, F.col("p2")).otherwise(F.col("p1"))
    a2 = F.when(k % 14 == 0, F.substring("p1", 1, 4)).when(k % 7 == 0, F.col("p1")).when(k % 5 == 0, "other").otherwise(F.col("p2"))
    return d.unionAll(d.where(k % 11 == 0)), d.select("name", a1.alias("a1"), a2.alias("a2"))


@query(f"WITH {CALLS} SELECT name, a1, a2, p1, p2, CASE WHEN a1 = p2 AND a2 = p1 THEN 'strict' ELSE 'prefix' END AS match_kind FROM j WHERE {SWAPPED} AND NOT {SAME}")
def arg_swap(spark, sf_dir):
    return swaps.swapped_calls(*part_calls(spark, sf_dir), ["name"])


@query(f"WITH {CALLS} SELECT name, a1, a2, p1, p2 FROM j WHERE NOT {SWAPPED} AND NOT {SAME}")
def arg_uncorrelated(spark, sf_dir):
    return swaps.uncorrelated_calls(*part_calls(spark, sf_dir), ["name"])


@query("""SELECT * FROM (SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'R')::INTEGER AS first_one, min(l_linenumber) FILTER (l_returnflag = 'N')::INTEGER AS first_other,
count(*) FILTER (l_returnflag = 'R') * count(*) FILTER (l_returnflag = 'N') - 1 AS additional_pairs FROM lineitem GROUP BY l_orderkey) WHERE additional_pairs >= 0""")
def contradictory_pair(spark, sf_dir):
    return swaps.contradictory_flags(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber", "R", "N")


@query("""WITH g AS (SELECT user_id, min(event_type) FILTER (event_type IN (SELECT DISTINCT event_type FROM events n WHERE n.user_id = e.user_id AND n.value < 20) AND value >= 20) AS tag FROM events e GROUP BY user_id)
SELECT * FROM g WHERE tag IS NOT NULL""")
def contradictory_tags(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    expr = F.array_join(F.sort_array(F.collect_set(F.concat(F.when(F.col("value") < 20, "!").otherwise(""), "event_type"))), " && ")
    positive, negative = swaps.tag_sets(F.col("x"))
    return e.groupBy("user_id").agg(expr.alias("x")).select("user_id", swaps.conflict(positive, negative).alias("tag")).where("tag IS NOT NULL")


# -- order, hierarchy, intervals

@query("""WITH e AS (SELECT *, ts::DATE AS day FROM events), t AS (SELECT user_id, day, min((ts, event_id)) AS t FROM e WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, day::VARCHAR AS day, arg_min(t[2], (ts, event_id)) AS terminator, arg_min(event_id, (ts, event_id)) AS next_location, count(*) AS n_after FROM e JOIN t USING (user_id, day) WHERE (ts, event_id) > t GROUP BY ALL""".replace("t[2]", "struct_extract(t, 2)"))
def first_terminator(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return ordered.first_terminator(e, ["user_id", "day"], ["ts", "event_id"], F.col("event_type") == "error", "event_id").withColumn("day", F.col("day").cast("string"))


PARENTS = "parents AS (SELECT r_name AS name, NULL::VARCHAR AS parent FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"
HANDLERS = """handlers AS (SELECT c_custkey % 40 AS try_id, c_custkey AS ord, CASE WHEN c_custkey % 25 = 0 THEN r_name WHEN c_custkey % 10 = 1 THEN n_name ELSE c_name END AS type FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey % 40, c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 6 = 0)"""


@query(f"""WITH RECURSIVE {PARENTS}, {HANDLERS}, up AS (SELECT name, name AS ancestor FROM parents UNION SELECT up.name, p.parent FROM up JOIN parents p ON p.name = up.ancestor WHERE p.parent IS NOT NULL),
met AS (SELECT h.try_id, h.ord, h.type, min(e.ord) AS first_at FROM handlers h LEFT JOIN up ON up.name = h.type LEFT JOIN handlers e ON e.try_id = h.try_id AND e.type = coalesce(up.ancestor, h.type) AND e.ord < h.ord GROUP BY ALL)
SELECT try_id, ord, min(first_at) AS by_ord FROM met GROUP BY try_id, ord HAVING count(*) = count(first_at)""")
def shadowed_handler(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    all_ = c.join(nr, F.col("c_nationkey") == F.col("n_nationkey"))
    parents = r.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent")).unionAll(nr.select("n_name", "r_name")).unionAll(all_.select("c_name", "n_name"))
    k = F.col("c_custkey")
    one = all_.select((k % 40).alias("try_id"), k.alias("ord"), F.when(k % 25 == 0, F.col("r_name")).when(k % 10 == 1, F.col("n_name")).otherwise(F.col("c_name")).alias("type"))
    return hierarchy.shadowed(one.unionAll(all_.where(k % 6 == 0).select(k % 40, k, "n_name")), hierarchy.ancestors(parents))


@query("""SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events i WHERE i.event_type = 'error' AND i.user_id = e.user_id AND e.ts >= i.ts AND e.ts <= i.ts + INTERVAL 6 HOUR AND (i.event_id % 3 <> 0 OR e.event_type IN ('click', 'view')))""")
def suppression_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    ids = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("click"), F.lit("view")))
    i = e.where("event_type = 'error'").select("user_id", F.col("at").alias("lo"), (F.col("at") + 6 * 3600 * 1_000_000).alias("hi"), ids.alias("ids"))
    return ordered.suppressed(e, i, ["user_id"], "at", "lo", "hi", 6 * 3600e6, "ids", "event_type").select("event_id", "user_id", "event_type")


PRINTS = "f AS (SELECT event_id, ts, event_type, regexp_replace(props, '[0-9]+', '#', 'g') AS message FROM events)"


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", strings.digits_to_hash(F.col("props")).alias("message"))


@query(f'WITH {PRINTS} SELECT event_type, message, count(*) AS "count" FROM f GROUP BY ALL')
def baseline_build(spark, sf_dir):
    return bags.baseline(fingerprints(spark, sf_dir), ["event_type", "message"])


@query(f"""WITH {PRINTS}, budget AS (SELECT event_type, message, count(*) AS n FROM f WHERE event_id % 3 = 0 AND event_type <> 'view' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, message ORDER BY ts, event_id) AS rn FROM f)
SELECT event_id, event_type, message FROM r LEFT JOIN budget USING (event_type, message) WHERE rn > coalesce(n, 0)""")
def baseline_ratchet(spark, sf_dir):
    f = fingerprints(spark, sf_dir)
    budget = bags.baseline(f.where("event_id % 3 = 0 AND event_type <> 'view'"), ["event_type", "message"])
    return bags.beyond_baseline(f, budget, ["event_type", "message"], F.to_date("ts"), ["ts", "event_id"]).select("event_id", "event_type", "message")


# -- documents: claims, filters

@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'all rights reserved') THEN 'all rights reserved' WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'token') THEN 'token' ELSE 'password' END AS trigger
FROM documents WHERE (contains(lower(text), 'all rights reserved') OR contains(lower(text), 'license') OR contains(lower(text), 'token') OR contains(lower(text), 'password')) AND NOT contains(lower(text), 'copyright')""")
def doc_claim_mismatch(spark, sf_dir):
    t = strings.first_trigger(F.col("text"), ["all rights reserved", "license", "token", "password"])
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("trigger"), "text").where(F.col("trigger").isNotNull() & ~F.lower("text").contains("copyright")).select("doc_id", "trigger")


@query("""SELECT doc_id, lang, source, CASE WHEN source = 'src3' THEN 'error' WHEN n_chars > 2000 THEN 'warning' ELSE 'note' END AS severity FROM documents
WHERE lang <> 'fr' AND NOT (lang = 'de' AND source IN ('src1', 'src2')) AND source NOT IN ('src7') AND NOT regexp_matches(source, '^src1[^/]$')""")
def configured_findings(spark, sf_dir):
    """Language filter, path globs, disabled detectors, suppression by language, severity by detector."""
    d = table(spark, sf_dir, "documents").where(F.col("lang") != "fr").where(strings.path_kept(F.col("source"), [], ["src1?"]))
    off = spark.createDataFrame([("src7",)], "source string")
    pairs = spark.createDataFrame([("de", "src1"), ("de", "src2")], "lang string, source string")
    remap = spark.createDataFrame([("src3", "error")], "source string, s string")
    d = d.join(off, "source", "left_anti").join(pairs, ["lang", "source"], "left_anti").join(remap, "source", "left")
    return d.select("doc_id", "lang", "source", F.coalesce("s", F.when(F.col("n_chars") > 2000, "warning").otherwise("note")).alias("severity"))


# -- priors and ranks

TPFP = "c AS (SELECT {g}, count(*) FILTER (quality = 1) AS tp, count(*) FILTER (quality = 0) AS fp FROM labels JOIN documents USING (doc_id) GROUP BY ALL)"
WILSON = "greatest(0, (tp / (tp + fp) + 1.96::DOUBLE ^ 2 / (2 * (tp + fp)) - 1.96::DOUBLE * sqrt((tp / (tp + fp)) * (1 - tp / (tp + fp)) / (tp + fp) + 1.96::DOUBLE ^ 2 / (4 * (tp + fp) ^ 2))) / (1 + 1.96::DOUBLE ^ 2 / (tp + fp)))"
BETA = """bis AS (SELECT {g}, tp, fp, 0::DOUBLE AS lo, 1::DOUBLE AS hi, 0 AS i FROM c WHERE tp + fp < 30
  UNION ALL SELECT {g}, tp, fp, CASE WHEN p < 0.025 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN p < 0.025 THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, list_sum(list_transform(range(tp + 1, tp + fp + 2), lambda k: exp(lgamma(tp + fp + 2) - lgamma(k + 1) - lgamma(tp + fp + 2 - k)) * ((lo + hi) / 2) ^ k * (1 - (lo + hi) / 2) ^ (tp + fp + 1 - k))) AS p FROM bis WHERE i < 60))"""


def labelled(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return j.groupBy(by).agg(F.count(F.when(F.col("quality") == 1, 1)).alias("tp"), F.count(F.when(F.col("quality") == 0, 1)).alias("fp"))


def with_bounds(c: DataFrame) -> DataFrame:
    tp, fp = F.col("tp"), F.col("fp")
    return c.withColumn("posterior_tp", F.round(bounds.posterior(tp, fp), 6)).withColumn("lower", F.round(bounds.lower_bound(tp, fp), 6)).withColumn("method", bounds.bound_method(tp, fp))


@query(f"WITH {TPFP.format(g='lang')} SELECT lang, tp, fp, round((tp + 1) / (tp + fp + 2), 6) AS posterior_tp, round({WILSON}, 6) AS lower FROM c")
def priors_wilson(spark, sf_dir):
    tp, fp = F.col("tp"), F.col("fp")
    return labelled(spark, sf_dir, "lang").select("lang", "tp", "fp", F.round(bounds.posterior(tp, fp), 6).alias("posterior_tp"), F.round(bounds.wilson_lower(tp, fp), 6).alias("lower"))


PRIORS = f"""{TPFP.format(g='source')}, {BETA.format(g='source')},
priors AS (SELECT c.source, c.tp, c.fp, round((c.tp + 1) / (c.tp + c.fp + 2), 6) AS posterior_tp, round(CASE WHEN c.tp + c.fp >= 30 THEN {WILSON.replace('tp', 'c.tp').replace('fp', 'c.fp')} WHEN c.tp = 0 THEN 0 ELSE (lo + hi) / 2 END, 6) AS lower,
  CASE WHEN c.tp + c.fp < 30 THEN 'jeffreys' ELSE 'wilson' END AS method FROM c LEFT JOIN (SELECT * FROM bis WHERE i = 60) b USING (source))"""


@query(f"WITH RECURSIVE {PRIORS} SELECT * FROM priors")
def priors_jeffreys(spark, sf_dir):
    return with_bounds(labelled(spark, sf_dir, "source"))


@query(f"""WITH RECURSIVE {PRIORS}, r AS (SELECT source, count(*) FILTER (n_chars > 2000) AS related FROM documents GROUP BY source)
SELECT source, related, posterior_tp, lower, round(CASE WHEN lower IS NULL THEN related ELSE lower * (1 + log2(1 + related)) END, 5) AS rank_score FROM r LEFT JOIN (SELECT * FROM priors WHERE source <> 'src5') p USING (source)""")
def rank_calibrated(spark, sf_dir):
    f = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.when(F.col("n_chars") > 2000, 1)).alias("related"))
    p = with_bounds(labelled(spark, sf_dir, "source")).where("source <> 'src5'").select("source", "posterior_tp", "lower")
    return f.join(p, "source", "left").select("source", "related", "posterior_tp", "lower", F.round(bounds.rank_score(F.col("lower"), F.col("related")), 5).alias("rank_score"))


@query("SELECT source, n_chars, doc_id FROM documents ORDER BY n_chars DESC, source, doc_id LIMIT 5")
def rank_top(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "n_chars", "doc_id").orderBy(F.desc("n_chars"), "source", "doc_id").limit(5)


@query(f"WITH RECURSIVE {PRIORS}, n AS (SELECT source AS detector_id, count(*) AS n FROM documents GROUP BY source) SELECT detector_id, n, lower FROM n LEFT JOIN priors ON source = detector_id")
def scan_summary(spark, sf_dir):
    p = with_bounds(labelled(spark, sf_dir, "source")).select(F.col("source").alias("detector_id"), "lower")
    return sinks.summary(table(spark, sf_dir, "documents").select(F.col("source").alias("detector_id")), p)


@query("SELECT s.threshold, EXISTS (SELECT 1 FROM documents WHERE CASE WHEN n_chars > 100000000 THEN 3 WHEN n_chars > 2000 THEN 2 ELSE 1 END >= s.r) AS fails FROM (VALUES ('error', 3), ('warning', 2), ('never', 9)) s(threshold, r)")
def fail_on(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") > 100_000_000, "error").when(F.col("n_chars") > 2000, "warning").otherwise("note").alias("severity"))
    top = f.agg(F.coalesce(F.max(strings.severity_rank(F.col("severity"))), F.lit(-1)).alias("top"))
    return top.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col("top") >= r).alias("fails")) for t, r in (("error", 3), ("warning", 2), ("never", 9))])).alias("s")).select("s.*")


# -- evaluation

MATCH = """ac AS (SELECT {k}, count(*) AS a FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 {x} GROUP BY ALL), ex AS (SELECT {k}, count(*) AS e FROM labels JOIN documents USING (doc_id) WHERE quality = 1 {x} GROUP BY ALL),
m AS (SELECT {g}, sum(least(coalesce(a, 0), coalesce(e, 0)))::BIGINT AS tp, sum(greatest(coalesce(a, 0) - coalesce(e, 0), 0))::BIGINT AS fp, sum(greatest(coalesce(e, 0) - coalesce(a, 0), 0))::BIGINT AS fn FROM ac FULL JOIN ex USING ({k}) GROUP BY {g})"""
PRF = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r"
SCORED = "round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1"


def actual_expected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return j.where("toxic = 0"), j.where("quality = 1")


@query(f"""WITH {MATCH.format(k='lang, source', g='lang', x='')}, o AS (SELECT * FROM m UNION ALL SELECT 'overall', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM m), s AS (SELECT *, {PRF} FROM o)
SELECT lang, tp, fp, fn, {SCORED} FROM s""")
def eval_prf(spark, sf_dir):
    return bags.scores(bags.matched(*actual_expected(spark, sf_dir), ["lang", "source"], ["lang"]), "lang")


@query("""WITH ac AS (SELECT lang, source, count(*) AS a FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 GROUP BY ALL), ex AS (SELECT lang, source, count(*) AS e FROM labels JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY ALL),
m AS (SELECT lang, source, least(coalesce(a, 0), coalesce(e, 0)) AS tp, greatest(coalesce(e, 0) - coalesce(a, 0), 0) AS fn FROM ac FULL JOIN ex USING (lang, source))
SELECT lang, coalesce(source, 'overall') AS source, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, round(CASE WHEN sum(tp + fn) = 0 THEN 0 ELSE sum(tp) / sum(tp + fn) END, 6) AS recall FROM m GROUP BY GROUPING SETS ((lang, source), (lang))""")
def recall_by_source(spark, sf_dir):
    m = bags.matched(*actual_expected(spark, sf_dir), ["lang", "source"], ["lang", "source"])
    g = m.groupingSets([[F.col("lang"), F.col("source")], [F.col("lang")]], "lang", "source").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"))
    return g.select("lang", F.coalesce("source", F.lit("overall")).alias("source"), "tp", "fn", F.round(F.when(F.col("tp") + F.col("fn") == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn"))), 6).alias("recall"))


@query(f"""WITH cur AS (WITH {MATCH.format(k='lang, source', g='lang', x="AND doc_id % 2 = 0 AND lang <> 'es'")}, s AS (SELECT *, {PRF} FROM m) SELECT lang, {SCORED} FROM s),
prev AS (WITH {MATCH.format(k='lang, source', g='lang', x="AND doc_id % 2 = 1 AND lang <> 'fr'")}, s AS (SELECT *, {PRF} FROM m) SELECT lang, {SCORED} FROM s)
SELECT lang, coalesce(c.precision, 0) AS precision_now, p.precision AS precision_before, round(coalesce(c.precision, 0) - p.precision, 6) AS precision_delta,
coalesce(c.recall, 0) AS recall_now, p.recall AS recall_before, round(coalesce(c.recall, 0) - p.recall, 6) AS recall_delta,
coalesce(c.f1, 0) AS f1_now, p.f1 AS f1_before, round(coalesce(c.f1, 0) - p.f1, 6) AS f1_delta FROM cur c FULL JOIN prev p USING (lang)""")
def snapshot_delta(spark, sf_dir):
    def part(where: str) -> DataFrame:
        a, e = actual_expected(spark, sf_dir)
        return bags.scores(bags.matched(a.where(where), e.where(where), ["lang", "source"], ["lang"]), "lang", None)

    return bags.delta(part("doc_id % 2 = 0 AND lang <> 'es'"), part("doc_id % 2 = 1 AND lang <> 'fr'"), "lang", ["precision", "recall", "f1"])


KAPPA = """r AS (SELECT lang, doc_id, unnest([{'rater': 'long', 'v': CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END}, {'rater': 'quality', 'v': quality}, {'rater': 'safe', 'v': 1 - toxic}]) AS x FROM labels JOIN documents USING (doc_id)),
pr AS (SELECT a.lang, a.x.rater || '-' || b.x.rater AS pair, a.x.v AS x, b.x.v AS y FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.lang = b.lang AND a.x.rater < b.x.rater),
t AS (SELECT lang, pair, count(*) AS n, count(*) FILTER (x = y) / count(*) AS po, (count(*) FILTER (x = 1) * count(*) FILTER (y = 1) + count(*) FILTER (x = 0) * count(*) FILTER (y = 0)) / (count(*) * count(*)) AS pe FROM pr GROUP BY ALL),
kp AS (SELECT lang, pair, n, CASE WHEN abs(1 - pe) > 1e-12 THEN round((po - pe) / (1 - pe), 6) END AS kappa FROM t)"""


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    votes = {"long": F.when(F.col("n_chars") > 1500, 1).otherwise(0), "quality": F.col("quality"), "safe": 1 - F.col("toxic")}
    return j.select("lang", "doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("rater"), v.cast("int").alias("v")) for k, v in votes.items()])).alias("x")).select("lang", "doc_id", "x.rater", "x.v")


@query(f"WITH {KAPPA} SELECT * FROM kp")
def kappa_pairs(spark, sf_dir):
    return agreement.kappa_pairs(rated(spark, sf_dir), ["lang"], "doc_id", "rater", "v")


@query(f"WITH {KAPPA} SELECT lang, max(n) AS n, min(kappa) AS min_kappa, max(n) < 5 AS low_n, max(n) >= 5 AND coalesce(min(kappa) < 0.6, false) AS low_reliability FROM kp GROUP BY lang")
def kappa_cells(spark, sf_dir):
    return agreement.kappa_cells(kappa_pairs(spark, sf_dir), ["lang"])


@query(f"WITH {KAPPA} SELECT * FROM kp WHERE n >= 5 AND kappa IS NOT NULL ORDER BY kappa, lang, pair LIMIT 1")
def kappa_worst(spark, sf_dir):
    return agreement.worst_cell(kappa_pairs(spark, sf_dir), ["lang"])


CONF = "c AS (SELECT lang, (doc_id * 37 % 101) / 100 AS conf, quality FROM labels JOIN documents USING (doc_id))"
BINS = "b AS (SELECT least(floor(conf * 10), 9)::BIGINT AS bin, count(*) AS n, avg(conf) AS mean_confidence, avg(quality) AS share FROM c GROUP BY 1)"


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return j.select("lang", ((F.col("doc_id") * 37 % 101) / 100).alias("conf"), "quality")


@query(f"WITH {CONF}, {BINS} SELECT bin, n, round(mean_confidence, 6) AS mean_confidence, round(share, 6) AS share FROM b")
def ece_bins(spark, sf_dir):
    b = agreement.calibration_bins(confidences(spark, sf_dir), F.col("conf"), F.col("quality"))
    return b.select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("share", 6).alias("share"))


@query(f"WITH {CONF}, {BINS} SELECT round(sum(n * abs(mean_confidence - share)) / sum(n), 6) AS ece FROM b")
def ece(spark, sf_dir):
    return agreement.calibration_error(agreement.calibration_bins(confidences(spark, sf_dir), F.col("conf"), F.col("quality")))


@query()
def platt_fit(spark, sf_dir):
    return agreement.platt_fit(confidences(spark, sf_dir), ["lang"], "conf", "quality")


@query(f"WITH {CONF} SELECT lang, conf, count(*) AS n, round(1 / (1 + exp(-(2.5::DOUBLE * conf - 0.75::DOUBLE))), 6) AS calibrated FROM c GROUP BY ALL")
def platt_apply(spark, sf_dir):
    got = confidences(spark, sf_dir).withColumn("calibrated", F.round(bounds.sigmoid_clamped(F.col("conf"), F.lit(2.5), F.lit(-0.75)), 6))
    return got.groupBy("lang", "conf", "calibrated").agg(F.count("*").alias("n"))


# -- names and routes

HOST = r"regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^(www|m)\.', '')"


@query(f"WITH u AS (SELECT page_id, {HOST} AS host FROM pages) SELECT page_id, host FROM u WHERE host IN (SELECT host FROM u GROUP BY host HAVING count(*) >= 2)")
def url_normalise_semi(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select("page_id", strings.url_normal(F.col("url")).alias("host"))
    return u.join(u.groupBy("host").agg(F.count("*").alias("n")).where("n >= 2"), "host", "left_semi").select("page_id", "host")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\.([^./]+)$', 1) AS e FROM pages) SELECT page_id, CASE e WHEN 'html' THEN 'page' WHEN 'org' THEN 'site' WHEN 'php' THEN 'script' END AS kind FROM p WHERE e IN ('html', 'org', 'php')""")
def route_by_suffix(spark, sf_dir):
    path = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return table(spark, sf_dir, "pages").select("page_id", strings.route(path, {"html": "page", "org": "site", "php": "script"}).alias("kind")).where("kind IS NOT NULL")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(split_part(url, '://', 2), '[?#].*$', '') AS path FROM pages), m AS (SELECT page_id, replace(replace(path, '/en/', '/src/'), '/fr/', '/tests/') AS path FROM p)
SELECT page_id, CASE WHEN contains(path, '/src/') THEN split_part(path, '/src/', 1) WHEN contains(path, '/tests/') THEN split_part(path, '/tests/', 1) WHEN regexp_extract(path, '([^/]*)$', 1) LIKE '_%\_\_%' ESCAPE '\' THEN split_part(regexp_extract(path, '([^/]*)$', 1), '__', 1) ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS scope FROM m""")
def scope_key(spark, sf_dir):
    path = F.regexp_replace(F.split_part("url", F.lit("://"), F.lit(2)), r"[?#].*$", "")
    path = F.replace(F.replace(path, F.lit("/en/"), F.lit("/src/")), F.lit("/fr/"), F.lit("/tests/"))
    return table(spark, sf_dir, "pages").select("page_id", strings.scope_key(path, F.lit("")).alias("scope"))


# -- editor events, corpus figures, sinks

@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS n, arg_max(event_type, (ts, event_id)) AS latest FROM s GROUP BY user_id, k""")
def lsp_debounce(spark, sf_dir):
    return ordered.debounced(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours", "event_type", ["ts", "event_id"])


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'error' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_clean FROM events")
def lsp_last_clean(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ordered.last_known(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") != "error", F.col("props")), "last_clean", F.to_date("ts")).select("event_id", "user_id", "last_clean")


@query("SELECT user_id, max(event_id) AS generation, arg_max(event_type, event_id) AS published FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'signup'")
def lsp_generation(spark, sf_dir):
    """Only the latest generation of each document is published; closed documents are left out."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("generation"), F.max_by("event_type", "event_id").alias("published"))
    return g.where("published <> 'signup'")


@query("SELECT count(*) AS file_count, sum(len(string_split(text, chr(10))))::BIGINT AS total_loc FROM documents")
def corpus_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("file_count"), F.sum(F.size(F.split("text", "\n"))).alias("total_loc"))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS origins, sha256(source) AS checksum FROM documents GROUP BY source")
def origins(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("origins"), F.sha2("source", 256).alias("checksum"))


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_claim_mismatch(spark, sf_dir)
    place = lambda line: F.struct(F.concat(F.lit("doc/"), "doc_id").alias("file"), F.lit(line).alias("start_line"), F.lit(1).alias("start_col"), F.lit(line).alias("end_line"), F.lit(2).alias("end_col"))
    return d.select(F.lit("doc-claim").alias("detector_id"), place(1).alias("primary"), F.array(place(2)).alias("related"), F.concat(F.lit("claims "), "trigger").alias("message"), F.lit("note").alias("severity"))


@query()
def sarif_results(spark, sf_dir):
    return sinks.sarif_results(document_findings(spark, sf_dir))


@query("""SELECT 'doc/' || doc_id AS uri, 'INFORMATION' AS severity, 'doc-claim' AS code, 0 AS start_line FROM documents
WHERE (contains(lower(text), 'all rights reserved') OR contains(lower(text), 'license') OR contains(lower(text), 'token') OR contains(lower(text), 'password')) AND NOT contains(lower(text), 'copyright')""")
def lsp_diagnostics(spark, sf_dir):
    d = sinks.diagnostics(document_findings(spark, sf_dir))
    return d.select("uri", "severity", "code", F.col("range.start_line").alias("start_line"))




# -- the whole scan, over sources written from part names

SOURCES = """p AS (SELECT p_partkey AS k, 'v_' || split_part(p_name, ' ', 1) AS p1, 'v_' || split_part(p_name, ' ', 2) AS p2 FROM part),
f AS (SELECT *, 'parts/p' || (k // 20) || '.py' AS file, (sum(CASE WHEN k % 7 = 0 THEN 6 ELSE 4 END) OVER (PARTITION BY k // 20 ORDER BY k) - CASE WHEN k % 7 = 0 THEN 6 ELSE 4 END)::INTEGER AS before FROM p WHERE p1 <> p2),
c AS (SELECT *, p2 AS a1, p1 AS a2 FROM f)"""


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of twenty functions each: one that goes on after its return, and for every seventh part a swapped call."""
    w = F.split("p_name", " ")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("v_"), F.get(w, F.lit(0))).alias("a"), F.concat(F.lit("v_"), F.get(w, F.lit(1))).alias("b")).where("a <> b")
    text = F.format_string("def part_%d(%s, %s):\n    t = %s + %s\n    return t\n    log(t)\n", "k", "a", "b", "a", "b")
    call = F.when(F.col("k") % 7 == 0, F.format_string("def use_%d(%s, %s):\n    return part_%d(%s, %s)\n", "k", "a", "b", "k", "b", "a")).otherwise("")
    files = p.groupBy(F.floor(F.col("k") / 20).alias("g")).agg(F.sort_array(F.collect_list(F.struct("k", F.concat(text, call).alias("t")))).alias("t"))
    return files.select(F.format_string("parts/p%d.py", "g").alias("path"), F.lit("python").alias("language"), F.array_join(F.transform("t", lambda x: x["t"]), "").alias("source"))


@query(f"""WITH {SOURCES} SELECT 'unreachable-after-terminator' AS detector_id, file, before + 4 AS line FROM c UNION ALL SELECT 'arg-swap', file, before + 6 FROM c WHERE k % 7 = 0 AND {SWAPPED} AND NOT {SAME}""")
def scan_corpus(spark, sf_dir):
    return scan(part_sources(spark, sf_dir)).select("detector_id", "file", "line")
