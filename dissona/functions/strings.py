"""Text functions: routes, scopes, fingerprints, normal forms, ordered triggers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go"}
SEVERITIES = {"info": 0, "note": 1, "warning": 2, "error": 3}


def lookup(table: dict[str, object], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def route(path: Column, table: dict[str, str] = LANGUAGES) -> Column:
    """The entry of a path's extension, case-sensitive; null without one."""
    return lookup(table, F.regexp_extract(path, r"\.([^./]+)$", 1))


def severity_rank(s: Column) -> Column:
    return lookup(SEVERITIES, s)


def digits_to_hash(s: Column) -> Column:
    return F.regexp_replace(s, "[0-9]+", "#")


def relative(path: Column, root: Column) -> Column:
    """Path below a root with forward slashes; the root itself gives its base name."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.when(p == r, F.element_at(F.split(p, "/"), -1)).when(F.startswith(p, F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p))).otherwise(p)


def url_shaped(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9+.-]+://.+")


def scope_key(path: Column, head: Column) -> Column:
    """Which members may be compared: a provenance URL in the first 512 characters, else what stands before /src/,
    /tests/ or /examples/, else the part before __ of the base name, else the folder."""
    url = F.regexp_extract(F.substring(head, 1, 512), r"[Ss]ource:\s*([A-Za-z0-9+.-]+://\S+)", 1)
    before = F.lit(None).cast("string")
    for mark in ("/examples/", "/tests/", "/src/"):
        before = F.when(F.instr(path, mark) > 0, F.substring_index(path, mark, 1)).otherwise(before)
    before = F.when(path.rlike("^(src|tests|examples)/"), "").otherwise(before)
    base = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.when(url != "", url), before, F.when(F.instr(base, "__") > 1, F.substring_index(base, "__", 1)), F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def first_trigger(text: Column, triggers: list[str]) -> Column:
    """The first of the list, in its order, that the lower-cased text contains."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(t), F.lit(t)) for t in triggers])


def doi(s: Column) -> Column:
    """Lower case, without resolver or scheme in front and punctuation behind."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"^(https?://)?(dx\.)?(doi\.org/)?(doi:\s*)?", ""), r"[.,;)\s]+$", "")


def url_normal(url: Column) -> Column:
    """Host of a URL in lower case, without www. and m. in front."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)), r"^(www|m)\.", "")


def glob_regex(glob: str) -> str:
    """A path glob (*, **, ?) as an anchored regular expression; * stays within a segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".^$+{}()|[]\\" else c
            i += 1
    return f"^{out}$"


def path_kept(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusion wins; an empty include list admits all."""
    hit = lambda globs: F.coalesce(*[F.when(path.rlike(glob_regex(g)), True) for g in globs], F.lit(False))
    return (hit(include) if include else F.lit(True)) & ~(hit(exclude) if exclude else F.lit(False))


def cfg_form(s: Column) -> Column:
    """The predicate of a cfg attribute with its white space collapsed; null for others, cfg_attr among them."""
    inner = F.regexp_extract(s, r"^#!?\[\s*cfg\s*\((.*)\)\s*\]$", 1)
    return F.when(inner != "", F.trim(F.regexp_replace(inner, r"\s+", " ")))


def cfg_negated(s: Column) -> Column:
    """What a not(...) holds, else null."""
    inner = F.regexp_extract(s, r"^not\s*\((.*)\)$", 1)
    return F.when(inner != "", F.trim(inner))


def model_family(name: Column, families: dict[str, list[str]]) -> Column:
    """The first family one of whose marks the lower-cased model name contains, else unknown."""
    low, out = F.lower(name), F.lit("unknown")
    for family, marks in reversed(families.items()):
        for m in reversed(marks):
            out = F.when(low.contains(m), family).otherwise(out)
    return out


def strip_fence(s: Column) -> Column:
    """An answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def verdict(answer: Column) -> Column:
    """(verdict, confidence clamped to 0..1, rationale) of a JSON answer; null where it is none or the verdict is unknown."""
    v = F.from_json(strip_fence(answer), "verdict string, confidence double, rationale string")
    known = v["verdict"].isin("LikelyTruePositive", "LikelyFalsePositive", "Uncertain")
    return F.when(known, F.struct(v["verdict"].alias("verdict"), F.least(F.greatest(F.coalesce(v["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.coalesce(v["rationale"], F.lit("")).alias("rationale")))
