"""Parsers, detectors and the scan on small sources."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from dissona.plans import scan, sinks
from dissona.sources import code

BODY = "".join(f"    x{i} = f{i}(a, {i}) + b.c{i}\n" for i in range(6))
FILES = {
    "swap.py": "def area(width, height):\n    return width * height\n\n\ndef use(width, height):\n    return area(height, width)\n",
    "dead.py": "def f(x):\n    if x:\n        return 1\n        g()\n        h()\n    while x:\n        break\n    return 2\n",
    "allowed.py": "def f(x):\n    return 1\n    g()  # dissona: allow(unreachable-after-terminator)\n",
    "except.py": "class Own(ValueError):\n    pass\n\n\ntry:\n    f()\nexcept (ValueError, KeyError):\n    pass\nexcept Own:\n    pass\nexcept OSError:\n    pass\nexcept:\n    pass\n",
    "docs.py": 'def f(x):\n    """Raises an error, and is deprecated."""\n    return x\n\n\n@warnings.deprecated("x")\ndef g(x):\n    """Deprecated; raises."""\n    raise ValueError\n',
    "drift_a.py": f"def one(a, b, c):\n{BODY}    return a\n\n\ndef two(a, b, c):\n{BODY}    return a\n\n\ndef three(a, b, c):\n{BODY}    return not a\n",
    "branch.py": "def f(x):\n    if x:\n        first = compute(x, 1)\n        y = 1\n    else:\n        first = compute(x, 1)\n        y = 2\n    return first, y\n",
    "lib.rs": "#[cfg(unix)]\n#[cfg( not(unix) )]\nfn f() {\n}\n\n#[cfg(unix)]\nfn g() {}\n\n#[dissona::allow(config-interaction)]\n#[cfg(a)]\n#[cfg(not(a))]\nfn h() {}\n",
    "tag.go": "// text\n\n//go:build linux && !linux\n\npackage x\n",
    "fine.go": "package x\n\n//go:build a && !a\n",
    "bad.py": "def (\n",
    "other.ts": "const x = 1;\n",
}
FILES["elsewhere.py"] = "try:\n    f()\nexcept KeyError:\n    pass\nexcept Own:\n    pass\n"  # Own is a class of another file
FILES["lock_classes.py"] = "class OSError(KeyError):\n    pass\n"
FILES |= {f"lock{i}.py": f"def f{i}():\n    acquire_it(x)\n    work{i}()\n" + ("    release_it(x)\n" if i else "") for i in range(24)}
FILES |= {f"free{i}.py": f"def f{i}():\n    a{i}(y)\n    b{i}(y)\n" for i in range(30)}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, s) for p, s in FILES.items()], "path string, source string").withColumn("language", scan.strings.route(F.col("path")))


def test_findings(files):
    got = sorted((r["detector_id"], r["file"], r["line"]) for r in scan.scan(files).collect())
    assert got == [
        ("arg-swap", "swap.py", 6), ("build-tag-interaction-go", "tag.go", 3), ("clone-drift", "branch.py", 2), ("clone-drift", "drift_a.py", 21), ("comment-code", "docs.py", 1), ("comment-code", "docs.py", 1),
        ("config-interaction", "lib.rs", 3), ("pr-miner", "lock0.py", 1), ("python-unreachable-except", "except.py", 9), ("unreachable-after-terminator", "dead.py", 4),
    ]


def test_configuration_ranks_and_sinks(spark, files, tmp_path):
    config = scan.Config.from_toml("[detectors.arg-swap]\nenabled = false\n[detectors.pr-miner]\nseverity = 'Error'\n[languages.go]\nsuppress = ['build-tag-interaction-go']\n[languages.rust]\nenabled = false\n[paths]\nexclude = ['dead.*']\n")
    found = scan.scan(files, config)
    assert {r["detector_id"] for r in found.collect()} == {"clone-drift", "comment-code", "pr-miner", "python-unreachable-except"}
    priors = spark.createDataFrame([("pr-miner", 32, 0), ("clone-drift", 1, 3)], "detector_id string, tp long, fp long")
    rows = scan.in_order(scan.ranked(found, priors)).collect()
    assert rows[0]["detector_id"] == "pr-miner" and abs(rows[0]["lower"] - 0.8928) < 1e-3
    wide = found.select("detector_id", F.struct(F.col("file"), F.col("line").alias("start_line"), F.lit(1).alias("start_col"), F.col("end_line"), F.lit(1).alias("end_col")).alias("primary"), F.array().cast(f"array<{sinks.LOCATION}>").alias("related"), "message", "severity")
    n = sinks.write_sarif(wide, str(tmp_path / "x.sarif"), "dissona", "1", [])
    doc = json.loads((tmp_path / "x.sarif").read_text())
    assert n == len(doc["runs"][0]["results"]) == len(rows) and {r["level"] for r in doc["runs"][0]["results"]} == {"warning", "note", "error"}
    assert sinks.fails(found, "error") and not sinks.fails(found.where("severity <> 'error'"), "error") and not sinks.fails(found, "never")
    with pytest.raises(ValueError, match="unknown"):
        scan.Config.from_toml("[detectors.x]\ncolour = 1\n")


def test_files_are_read(spark, tmp_path):
    for p in ("a/b.py", "a/c.txt", "a/.hidden/d.py", "e.go", "f.PY"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert sorted((r["path"], r["language"]) for r in code.read_files(spark, str(tmp_path)).collect()) == [("a/b.py", "python"), ("e.go", "go")]
    assert [r["path"] for r in code.read_files(spark, str(tmp_path), exclude=["a/**"]).collect()] == ["e.go"]


def test_nothing_to_scan(spark, files):
    assert scan.scan(files.limit(0)).count() == 0
    odd = spark.createDataFrame([("n.py", None, "python"), ("m.py", "\0", "python"), ("q.py", "", "python")], "path string, source string, language string")
    assert [r["parse_recovered"] for r in code.units(odd).orderBy("path").collect()] == [True, True, False]


def test_files_are_parsed_by_more_tasks_than_their_bytes_make(spark):
    from dissona.sources.code import units

    rows = [(f"p{i}.py", "python", "def f(a):\n    return a\n") for i in range(64)]
    files = spark.createDataFrame(rows, "path string, language string, source string").groupBy("path", "language").agg(F.max("source").alias("source"))
    assert units(files).select(F.spark_partition_id().alias("p")).distinct().count() >= 8
