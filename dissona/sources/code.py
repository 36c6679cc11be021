"""Source files to relations: discovery, routing, reading, and one parse per file into nested columns.

`units` parses each file once (Python with the standard library's parser; Go and Rust by their lines, for build tags,
cfg attributes and suppressions) and keeps the rows of every relation of a file in arrays; relations are exploded from
that one table. Files that cannot be read or parsed stay as rows with parse_recovered, and detectors skip them."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissona.functions.strings import path_kept, relative, route

SPAN = "start_line:int,start_col:int,end_line:int,end_col:int"
FN = f"struct<fn_id:int,name:string,params:array<string>,plain:boolean,is_method:boolean,doc:string,tokens:array<string>,decorators:array<string>,has_raise:boolean,returns_call:boolean,callees:array<string>,{SPAN}>"
CALL = f"struct<name:string,args:array<string>,{SPAN}>"
STMT = f"struct<block_id:int,ord:int,stops:boolean,{SPAN}>"
HANDLER = "struct<try_id:int,ord:int,type:string,line:int>"
CLASS = "struct<name:string,parent:string>"
BRANCH = f"struct<fn_id:int,yes:array<string>,no:array<string>,n_tokens:int,{SPAN}>"
ALLOW = "struct<ids:array<string>,start_line:int,end_line:int>"
CFG = "struct<item_line:int,predicates:array<string>>"
UNIT = f"path string, language string, head string, loc int, parse_recovered boolean, fns array<{FN}>, calls array<{CALL}>, stmts array<{STMT}>, handlers array<{HANDLER}>, classes array<{CLASS}>, branches array<{BRANCH}>, allows array<{ALLOW}>, cfgs array<{CFG}>, build_tag string, build_line int"
FIELDS = ["fns", "calls", "stmts", "handlers", "classes", "branches", "allows", "cfgs"]
EXITS = {"sys.exit", "os._exit", "exit", "quit"}


def read_files(spark: SparkSession, folder: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(path, language, source) of the supported files below a folder; hidden files and folders are skipped."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = relative(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), F.lit(re.sub("^[a-z]+:/*(?=/)", "", folder)))
    rows = f.select(path.alias("path"), F.col("content").cast("string").alias("source")).withColumn("language", route(F.col("path")))
    return rows.where(F.col("language").isNotNull() & ~F.col("path").rlike(r"(^|/)\.")).where(path_kept(F.col("path"), list(include), list(exclude))).select("path", "language", "source")


def _span(n: ast.AST) -> dict:
    return {"start_line": n.lineno, "start_col": n.col_offset + 1, "end_line": n.end_lineno, "end_col": n.end_col_offset + 1}


def _dotted(n: ast.AST) -> str | None:
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    return ".".join([n.id, *reversed(parts)]) if isinstance(n, ast.Name) else None


def _tokens(n: ast.AST) -> list[str]:
    """Node kinds in preorder; names and literals fold to placeholders and end the descent."""
    if isinstance(n, (ast.Name, ast.arg, ast.alias)):
        return ["$ID"]
    if isinstance(n, ast.JoinedStr):
        return ["$STR"]
    if isinstance(n, ast.Constant):
        v = n.value
        return ["$BOOL" if isinstance(v, bool) else "$INT" if isinstance(v, int) else "$FLOAT" if isinstance(v, float) else "$STR" if isinstance(v, (str, bytes)) else "none"]
    if isinstance(n, (ast.Load, ast.Store, ast.Del)):
        return []
    out = [] if isinstance(n, (ast.arguments, ast.keyword)) else [type(n).__name__.lower()]
    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        out.append("$ID")
    for c in ast.iter_child_nodes(n):
        out += _tokens(c)
    if isinstance(n, ast.Attribute):
        out.append("$ID")
    return out


def _stops(s: ast.stmt) -> bool:
    """Whether control never passes the statement."""
    if isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
        return True
    if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
        return _dotted(s.value.func) in EXITS
    if isinstance(s, ast.Assert):
        return isinstance(s.test, ast.Constant) and not s.test.value
    return isinstance(s, ast.If) and bool(s.orelse) and not (len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If)) and any(map(_stops, s.body)) and any(map(_stops, s.orelse))


def _allows(source: str, marker: str) -> list[dict]:
    """`# marker: allow(a, b)`: on a line of code that line; alone the statement that follows; () for all detectors."""
    out, tree = [], ast.parse(source)
    spans = sorted((n.lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, ast.stmt))
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        m = re.match(rf"#\s*{re.escape(marker)}:\s*allow\(([^)]*)\)", t.string) if t.type == tokenize.COMMENT else None
        if m:
            ids = [x.strip() for x in m[1].split(",") if x.strip()] or None
            line = t.start[0]
            if t.line[: t.start[1]].strip():
                out.append({"ids": ids, "start_line": line, "end_line": line})
            elif after := [s for s in spans if s[0] > line]:
                first = min(s[0] for s in after)
                out.append({"ids": ids, "start_line": first, "end_line": max(e for s, e in after if s == first)})
    return out


def parse_python(source: str, marker: str = "dissona") -> dict:
    """The relations of one Python file."""
    tree = ast.parse(source)
    out: dict[str, list] = {k: [] for k in FIELDS}
    lines = source.split("\n")
    blocks = tries = 0

    def text(n: ast.AST) -> str:
        return " ".join((ast.get_source_segment(source, n) or "").split())

    def block(body: list[ast.stmt]) -> None:
        nonlocal blocks
        blocks += 1
        for i, s in enumerate(body):
            out["stmts"].append({"block_id": blocks, "ord": i, "stops": _stops(s), **_span(s)})

    def visit(n: ast.AST, fn: int | None) -> None:
        nonlocal tries
        for field in ("body", "orelse", "finalbody"):
            body = getattr(n, field, None)
            if isinstance(body, list) and body and isinstance(body[0], ast.stmt) and not isinstance(n, (ast.Module, ast.ClassDef)):
                block(body)
        if isinstance(n, ast.Try):
            tries += 1
            for i, h in enumerate(n.handlers):
                kinds = h.type.elts if isinstance(h.type, ast.Tuple) else [h.type]
                for k in kinds:
                    name = "BaseException" if k is None else (_dotted(k) or "?").split(".")[-1]
                    out["handlers"].append({"try_id": tries, "ord": i, "type": name, "line": h.lineno})
        if isinstance(n, ast.Call) and n.args and not n.keywords and all(isinstance(a, ast.Name) for a in n.args):
            name = _dotted(n.func)
            if name and (("." not in name) or name.split(".")[0] in ("self", "cls") and name.count(".") == 1):
                out["calls"].append({"name": name.split(".")[-1], "args": [a.id for a in n.args], **_span(n)})
        if isinstance(n, ast.If) and n.orelse and fn is not None:
            tail = n.orelse
            while len(tail) == 1 and isinstance(tail[0], ast.If) and tail[0].orelse:
                tail = tail[0].orelse
            out["branches"].append({"fn_id": fn, "yes": [text(s) for s in n.body], "no": [text(s) for s in tail], "n_tokens": sum(len(_tokens(s)) for s in n.body), **_span(n)})
        if isinstance(n, ast.ClassDef):
            for b in n.bases or [None]:
                parent = (_dotted(b) or "").split(".")[-1] if b is not None else ""
                out["classes"].append({"name": n.name, "parent": parent or None})
        for c in ast.iter_child_nodes(n):
            visit(c, fn)

    def function(f: ast.FunctionDef, method: bool) -> None:
        a = f.args
        params = [x.arg for x in [*a.posonlyargs, *a.args]]
        if method and params and params[0] in ("self", "cls"):
            params = params[1:]
        plain = not (a.vararg or a.kwarg or a.kwonlyargs) and not any(p.startswith("_") for p in params)
        inside = [x for s in f.body for x in ast.walk(s)]
        callees = sorted({d.split(".")[-1] for x in inside if isinstance(x, ast.Call) and (d := _dotted(x.func))})
        for x in inside:  # a context manager closes what it opens
            for item in x.items if isinstance(x, (ast.With, ast.AsyncWith)) else []:
                name = (_dotted(item.context_expr.func) or "").split(".")[-1] if isinstance(item.context_expr, ast.Call) else ""
                callees += {"open": ["close"], "acquire": ["release"]}.get(name, [])
        fn = len(out["fns"])
        out["fns"].append({
            "fn_id": fn, "name": f.name, "params": params, "plain": plain, "is_method": method, "doc": ast.get_docstring(f), "tokens": _tokens(f), "decorators": [d for x in f.decorator_list if (d := _dotted(x.func if isinstance(x, ast.Call) else x))],
            "has_raise": any(isinstance(x, ast.Raise) for x in inside), "returns_call": any(isinstance(x, ast.Return) and isinstance(x.value, ast.Call) for x in inside), "callees": sorted(set(callees)), **_span(f),
        })
        visit(f, fn)

    for s in tree.body:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(s, False)
        elif isinstance(s, ast.ClassDef):
            visit(ast.ClassDef(s.name, s.bases, [], [], [], lineno=s.lineno, col_offset=s.col_offset), None)
            for m in s.body:
                function(m, True) if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) else visit(m, None)
        else:
            visit(s, None)
    return out | {"allows": _allows(source, marker), "loc": len(lines)}


def parse_rust(source: str, marker: str = "dissona") -> dict:
    """cfg predicates of each item (its contiguous attributes), and allow attributes with the lines of their item."""
    out: dict[str, list] = {k: [] for k in FIELDS}
    lines, held, allowed = source.split("\n"), [], None
    for i, line in enumerate(lines, 1):
        s = line.strip()
        if m := re.match(r"#!?\[\s*(cfg\s*\(.*\))\s*\]$", s):
            held.append(m[1])
        elif m := re.match(rf"#!?\[\s*{re.escape(marker)}::allow\s*\(([^)]*)\)\s*\]$", s):
            allowed = [x.strip() for x in m[1].split(",") if x.strip()]
        elif s.startswith("#[") or s.startswith("//") or not s:
            continue
        else:
            if held:
                out["cfgs"].append({"item_line": i, "predicates": [re.sub(r"\s+", " ", re.match(r"cfg\s*\((.*)\)$", h)[1]).strip() for h in held]})
            if allowed is not None:
                depth, end = 0, i
                for j in range(i - 1, len(lines)):
                    depth += lines[j].count("{") - lines[j].count("}")
                    end = j + 1
                    if depth <= 0 and ("}" in lines[j] or ";" in lines[j]):
                        break
                out["allows"].append({"ids": allowed or None, "start_line": i, "end_line": end})
            held, allowed = [], None
    return out | {"loc": len(lines)}


def parse_go(source: str) -> dict:
    """The first build line before the package clause."""
    out: dict = {k: [] for k in FIELDS} | {"loc": source.count("\n") + 1}
    for i, line in enumerate(source.split("\n"), 1):
        if line.startswith("package "):
            break
        if line.startswith("//go:build "):
            return out | {"build_tag": line[len("//go:build ") :].strip(), "build_line": i}
    return out


PARSERS = {"python": parse_python, "rust": parse_rust, "go": parse_go}


def units(files: DataFrame) -> DataFrame:
    """One row a file of (path, language, source), with its relations in arrays. Null sources and languages without a
    parser give rows without relations, marked parse_recovered.

    Parsing takes long for few bytes, so files are dealt over more tasks than their bytes would make."""
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, source in b.itertuples(index=False):
                row = {k: [] for k in FIELDS} | {"head": (source or "")[:512], "loc": 0, "build_tag": None, "build_line": None}
                bad = source is None or language not in PARSERS
                if not bad:
                    row["loc"] = source.count("\n") + 1
                    try:
                        row |= PARSERS[language](source)
                    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
                        bad = True
                rows.append({"path": path, "language": language, "parse_recovered": bad} | row)
            yield pd.DataFrame(rows, columns=["path", "language", "head", "loc", "parse_recovered", *FIELDS, "build_tag", "build_line"]).astype({"build_line": "Int32"})

    return files.select("path", "language", "source").repartition(tasks, "path").mapInPandas(run, UNIT)


def relation(parsed: DataFrame, name: str) -> DataFrame:
    """The rows of one relation of cleanly parsed files: (path, language, fields)."""
    return parsed.where("NOT parse_recovered").select("path", "language", F.explode(name).alias("r")).select("path", "language", "r.*")
