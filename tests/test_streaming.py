"""The editor stream: debounce, stale versions, closing, last clean findings."""

from __future__ import annotations

import json
import time

from dissona.streaming.editor import EVENT, Publisher, settled

DEAD = "def f():\n    return 1\n    g()\n"


def test_latest_version_after_the_gap(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def send(name, *events):
        (tmp_path / "tmp").write_text("\n".join(json.dumps(dict(zip(("uri", "kind", "version", "text"), e, strict=True))) for e in events))
        (tmp_path / "tmp").rename(tmp_path / "in" / f"{name}.json")

    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = settled(events, 100).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()

    def wait(n):
        for _ in range(300):
            if spark.table("settled").count() >= n:
                return
            time.sleep(0.2)

    try:
        send("1", ("a.py", "open", 1, "x"), ("a.py", "change", 3, "z"), ("a.py", "change", 2, "y"), ("b.py", "open", 1, "b"))
        wait(2)
        send("2", ("a.py", "change", 2, "late"), ("b.py", "close", 2, None))
        wait(3)
        send("3", ("b.py", "change", 3, "after the end"), ("a.py", "change", 4, "w"))
        wait(4)
    finally:
        q.stop()
    got = [(r["uri"], r["version"], r["text"], r["closed"]) for r in spark.table("settled").collect()]
    assert sorted(got) == [("a.py", 3, "z", False), ("a.py", 4, "w", False), ("b.py", 1, "b", False), ("b.py", 2, "", True)]


def test_last_clean_findings(spark, tmp_path):
    seen = []
    publish = Publisher(lambda df: seen.append({r["uri"]: [f["line"] for f in r["findings"]] for r in df.collect()}), f"file://{tmp_path}")
    schema = "uri string, version long, text string, closed boolean"
    for i, text in enumerate([DEAD, "def f(:\n", "def f():\n    return 1\n"]):
        publish(spark.createDataFrame([("a.py", i, text, False)], schema), i)
    publish(spark.createDataFrame([("a.py", 9, "", True)], schema), 9)
    assert seen == [{"a.py": [3]}, {"a.py": [3]}, {"a.py": []}, {"a.py": []}]
