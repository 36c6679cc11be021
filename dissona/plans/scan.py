"""The scan: detectors over relations of code, suppression, configuration, ranks and baselines.

Every detector gives rows of one schema (detector_id, file, line, end_line, message, severity, anomaly_class, related,
evidence), so their union passes the same filters whatever found them."""

from __future__ import annotations

import builtins
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dissona.functions import bounds, strings
from dissona.operators import assoc, bags, hierarchy, ordered, setsim, swaps
from dissona.sources.code import relation, units
from dissona.sources.scratch import stored

COLUMNS = ["detector_id", "file", "line", "end_line", "message", "severity", "anomaly_class", "related", "evidence"]
#: Calls that go with everything and so say nothing: exception classes, introspection, iteration, output.
STOP = {"python": "isinstance range callable enumerate len StopIteration Exception map zip super iter filter OSError NotImplementedError FileNotFoundError RuntimeError TypeError AttributeError ValueError ImportError IndexError KeyError repr delattr hasattr getattr setattr issubclass print next".split()}
RAISES = ["raises", "may raise", "throws"]


def finding(detector: str, file: Column, line: Column, end: Column, message: Column, severity: str, kind: str, related: Column | None = None, evidence: Column | None = None) -> list[Column]:
    values = [F.lit(detector), file, line.cast("int"), end.cast("int"), message, F.lit(severity), F.lit(kind), related if related is not None else F.array().cast("array<string>"), F.to_json(evidence) if evidence is not None else F.lit(None).cast("string")]
    return [v.alias(n) for v, n in zip(values, COLUMNS, strict=True)]


def place(path: str = "path", line: str = "start_line") -> Column:
    return F.concat_ws(":", path, F.col(line).cast("string"))


def arg_swap(parsed: DataFrame) -> DataFrame:
    fns = relation(parsed, "fns").where((F.size("params") == 2) & F.col("plain"))
    defs = fns.select("language", "name", F.get("params", F.lit(0)).alias("p1"), F.get("params", F.lit(1)).alias("p2"))
    calls = relation(parsed, "calls").where(F.size("args") == 2).select("path", "language", "name", F.get("args", F.lit(0)).alias("a1"), F.get("args", F.lit(1)).alias("a2"), "start_line", "end_line")
    got = swaps.swapped_calls(defs, calls, ["language", "name"])
    text = F.format_string("arguments of %s stand in the order (%s, %s), its parameters in (%s, %s)", "name", "a1", "a2", "p1", "p2")
    return got.select(*finding("arg-swap", F.col("path"), F.col("start_line"), F.col("end_line"), text, "warning", "Interface", evidence=F.struct("match_kind")))


def clone_drift(parsed: DataFrame) -> DataFrame:
    fns = relation(parsed, "fns").where("NOT is_method").withColumn("key", F.xxhash64("path", "fn_id"))
    heads = parsed.select("path", "head")
    fns = stored(fns.join(heads, "path").select("key", "path", "language", "name", "tokens", "start_line", "end_line", "head"), "fns")
    members = setsim.prepare(fns, "key", F.col("tokens"), F.concat_ws(":", "language", strings.scope_key(F.col("path"), F.col("head"))))
    found = setsim.drift(members, setsim.groups(setsim.linked(members)), fns.select(F.col("key").alias("id"), F.md5(F.concat_ws(" ", "tokens")).alias("form")))
    model = fns.select(F.col("key").alias("exemplar"), F.array(place()).alias("rel"), F.col("name").alias("other"))
    got = found.join(fns, F.col("drifted") == F.col("key")).join(model, "exemplar")
    text = F.format_string("%s has drifted from %s and its copies", "name", "other")
    return got.select(*finding("clone-drift", F.col("path"), F.col("start_line"), F.col("end_line"), text, "warning", "Logic", F.col("rel"), F.struct("group_size", "majority", "j")))


def branch_clones(parsed: DataFrame) -> DataFrame:
    """Both branches equal, or a shared beginning of at least 20 bytes before they part."""
    b = relation(parsed, "branches").withColumn("k", F.array_position(F.zip_with("yes", "no", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)))
    same = b.where((F.col("k") == 0) & (F.col("n_tokens") >= setsim.MIN_TOKENS)).select(*finding("clone-drift", F.col("path"), F.col("start_line"), F.col("end_line"), F.lit("both branches are the same"), "warning", "Logic"))
    lead = F.aggregate(F.slice("yes", F.lit(1), F.greatest(F.col("k") - 1, F.lit(0)).cast("int")), F.lit(0), lambda n, s: n + F.octet_length(s))
    part = b.where((F.col("k") > 1) & (lead >= 20)).select(*finding("clone-drift", F.col("path"), F.col("start_line"), F.col("end_line"), F.lit("both branches begin with the same statements"), "warning", "Logic"))
    return same.unionByName(part)


def comment_code(parsed: DataFrame) -> DataFrame:
    f = relation(parsed, "fns").where("NOT is_method AND doc IS NOT NULL")
    says = strings.first_trigger(F.col("doc"), RAISES)
    raises = f.where(says.isNotNull() & ~F.col("has_raise") & ~F.col("returns_call")).select(*finding("comment-code", F.col("path"), F.col("start_line"), F.col("end_line"), F.format_string("%s is said to raise and does not", "name"), "note", "Documentation"))
    last = F.transform("decorators", lambda d: F.element_at(F.split(d, r"\."), -1))
    old = f.where(F.lower("doc").contains("deprecated") & ~F.array_contains(last, "deprecated")).select(*finding("comment-code", F.col("path"), F.col("start_line"), F.col("end_line"), F.format_string("%s is said to be deprecated and is not marked", "name"), "note", "Documentation"))
    return raises.unionByName(old)


def unreachable(parsed: DataFrame) -> DataFrame:
    s = relation(parsed, "stmts").withColumn("at", F.struct("start_line", "end_line"))
    got = ordered.first_terminator(s, ["path", "block_id"], ["ord"], F.col("stops"), "at")
    text = F.format_string("%d statements follow one that control does not pass", "n_after")
    return got.select(*finding("unreachable-after-terminator", F.col("path"), F.col("next_location.start_line"), F.col("next_location.end_line"), text, "warning", "Logic"))


def builtin_parents(spark: SparkSession) -> DataFrame:
    kinds = [v for v in vars(builtins).values() if isinstance(v, type) and issubclass(v, BaseException)]
    return spark.createDataFrame([(k.__name__, k.__base__.__name__ if k is not BaseException else None) for k in kinds], "name string, parent string")


def unreachable_except(parsed: DataFrame) -> DataFrame:
    """A class of a file counts in that file alone: its name is qualified by the path wherever the file means it."""
    c = relation(parsed, "classes").where("parent IS NOT NULL").select("path", "name", "parent").distinct()
    own = c.select(F.col("path").alias("own_path"), F.col("name").alias("own")).distinct()

    def inside(df: DataFrame, name: str) -> DataFrame:
        met = df.alias("d").join(own.alias("o"), (F.col("d.path") == F.col("o.own_path")) & (F.col(f"d.{name}") == F.col("o.own")), "left")
        qualified = F.when(F.col("o.own").isNotNull(), F.concat_ws("#", "d.path", f"d.{name}")).otherwise(F.col(f"d.{name}")).alias(name)
        return met.select(*[qualified if x == name else F.col(f"d.{x}") for x in df.columns])

    h = inside(relation(parsed, "handlers").withColumn("key", F.concat_ws("#", "path", "try_id")), "type")
    local = inside(inside(c, "parent"), "name").select("name", "parent")
    closure = hierarchy.ancestors(builtin_parents(parsed.sparkSession).unionByName(local))
    got = hierarchy.shadowed(h.select(F.col("key").alias("try_id"), "ord", "type"), closure, ("BaseException",))
    lines = h.groupBy(F.col("key").alias("try_id"), "ord").agg(F.first("path").alias("path"), F.min("line").alias("line"))
    return got.join(lines, ["try_id", "ord"]).select(*finding("python-unreachable-except", F.col("path"), F.col("line"), F.col("line"), F.lit("an earlier handler covers this one"), "warning", "Logic"))


def pr_miner(parsed: DataFrame) -> DataFrame:
    fns = relation(parsed, "fns").where("NOT is_method").withColumn("tid", F.concat_ws("#", "path", "fn_id"))
    items = fns.select("tid", "language", "path", "start_line", "end_line", F.explode("callees").alias("item"))
    stop = items.sparkSession.createDataFrame([(k, x) for k, v in STOP.items() for x in v], "language string, item string")
    items = stored(items.join(stop, ["language", "item"], "left_anti"), "items")
    b = assoc.baskets(items, F.col("tid"), F.col("item"))
    found = assoc.rules(b)
    got = assoc.violations(b, found).join(items.select("tid", "path", "start_line", "end_line").distinct(), "tid").join(assoc.supporters(b, found), ["lhs", "rhs"])
    text = F.format_string("%s is called without %s, which goes with it in %d %% of places", "lhs", "rhs", "percent")
    return got.select(*finding("pr-miner", F.col("path"), F.col("start_line"), F.col("end_line"), text, "warning", "Logic", F.col("related"), F.struct("confidence", "related_capped")))


def config_interaction(parsed: DataFrame) -> DataFrame:
    """Items whose cfg predicates exclude each other: X and not(X), or true and false."""
    c = relation(parsed, "cfgs").withColumn("p", F.array_distinct("predicates"))
    negated = F.filter(F.transform("p", strings.cfg_negated), lambda x: x.isNotNull())
    both = F.array_intersect("p", negated)
    n = F.size(both) + F.when(F.array_contains("p", "true") & F.array_contains("p", "false"), 1).otherwise(0)
    c = c.withColumn("first", F.coalesce(F.get(both, F.lit(0)), F.lit("true"))).withColumn("n", n).where("n > 0")
    return c.select(*finding("config-interaction", F.col("path"), F.col("item_line"), F.col("item_line"), F.format_string("cfg asks for %s and excludes it", "first"), "warning", "Logic", evidence=F.struct((F.col("n") - 1).alias("additional_pairs"))))


def build_tags(parsed: DataFrame) -> DataFrame:
    positive, negative = swaps.tag_sets(F.col("build_tag"))
    t = parsed.where("build_tag IS NOT NULL").withColumn("tag", swaps.conflict(positive, negative)).where("tag IS NOT NULL")
    return t.select(*finding("build-tag-interaction-go", F.col("path"), F.col("build_line"), F.col("build_line"), F.format_string("the build line asks for %s and excludes it", "tag"), "warning", "Logic"))


DETECTORS = {
    "arg-swap": [arg_swap], "clone-drift": [clone_drift, branch_clones], "comment-code": [comment_code], "unreachable-after-terminator": [unreachable],
    "python-unreachable-except": [unreachable_except], "pr-miner": [pr_miner], "config-interaction": [config_interaction], "build-tag-interaction-go": [build_tags],
}


@dataclass
class Config:
    """disabled: detectors; severity: by detector; languages off; suppress: (language, detector) pairs; path globs."""

    disabled: set[str] = field(default_factory=set)
    severity: dict[str, str] = field(default_factory=dict)
    languages_off: set[str] = field(default_factory=set)
    suppress: set[tuple[str, str]] = field(default_factory=set)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    @classmethod
    def from_toml(cls, text: str) -> Config:
        """Tables detectors, paths and languages; unknown keys are errors."""
        import tomllib

        t = tomllib.loads(text)
        known = {"detectors": {"enabled", "severity"}, "languages": {"enabled", "suppress"}}
        if bad := set(t) - {"detectors", "paths", "languages"}:
            raise ValueError(f"unknown tables {sorted(bad)}")
        for name, keys in known.items():
            for k, v in t.get(name, {}).items():
                if bad := set(v) - keys:
                    raise ValueError(f"unknown keys {sorted(bad)} in {name}.{k}")
        if bad := set(t.get("paths", {})) - {"include", "exclude"}:
            raise ValueError(f"unknown keys {sorted(bad)} in paths")
        d, languages, paths = t.get("detectors", {}), t.get("languages", {}), t.get("paths", {})
        return cls(
            {k for k, v in d.items() if v.get("enabled") is False}, {k: v["severity"].lower() for k, v in d.items() if "severity" in v},
            {k for k, v in languages.items() if v.get("enabled") is False}, {(k, x) for k, v in languages.items() for x in v.get("suppress", [])},
            paths.get("include", []), paths.get("exclude", []),
        )


def scan(files: DataFrame, config: Config | None = None) -> DataFrame:
    """Findings over files (path, language, source), suppressed and configured, in COLUMNS."""
    config = config or Config()
    spark = files.sparkSession
    if config.languages_off:
        files = files.where(~F.col("language").isin(*config.languages_off))
    files = files.where(strings.path_kept(F.col("path"), config.include, config.exclude))
    parsed = stored(units(files), "units")
    out = bags.union_findings([f(parsed) for name, fs in DETECTORS.items() if name not in config.disabled for f in fs])
    allows = relation(parsed, "allows").select(F.col("path").alias("file"), "ids", "start_line", "end_line")
    out = ordered.suppressed(out, allows, ["file"], "line", "start_line", "end_line", 64.0, "ids", "detector_id")
    if config.suppress:
        off = spark.createDataFrame(sorted(config.suppress), "language string, detector_id string")
        out = out.withColumn("language", strings.route(F.col("file"))).join(off, ["language", "detector_id"], "left_anti")
    if config.severity:
        out = out.withColumn("severity", F.coalesce(strings.lookup(config.severity, F.col("detector_id")), "severity"))
    return out.select(*COLUMNS)


def ranked(findings: DataFrame, priors: DataFrame | None) -> DataFrame:
    """findings with posterior_tp, lower and rank_score; priors: (detector_id, tp, fp), one row a detector."""
    n = F.size("related").cast("long")
    if priors is None:
        return findings.withColumn("rank_score", n.cast("double"))
    tp, fp = F.col("tp"), F.col("fp")
    p = priors.select("detector_id", bounds.posterior(tp, fp).alias("posterior_tp"), bounds.lower_bound(tp, fp).alias("lower"))
    return findings.join(p, "detector_id", "left").withColumn("rank_score", bounds.rank_score(F.col("lower"), n))


def in_order(findings: DataFrame) -> DataFrame:
    """Rank order with every tie decided."""
    return findings.orderBy(F.desc("rank_score"), "file", "line", "detector_id", "end_line", "message")
