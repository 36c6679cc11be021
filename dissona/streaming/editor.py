"""Editor buffers as a stream: the latest version of each document after a quiet gap, then its findings.

Late versions are dropped by number, not by time: state holds the highest version seen of a document, and only that
one is published. A closed document publishes an empty buffer; its version is remembered for CLOSED_MS, so that an edit
that comes late does not open it again, and then forgotten. Only a new open event begins it anew."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dissona.functions.strings import route
from dissona.plans.scan import scan
from dissona.sources.code import units

EVENT = "uri string, kind string, version long, text string"
GAP_MS = 250
CLOSED_MS = 600_000


def _latest(gap_ms: int) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            version, text, waiting = state.get
            if text is None:
                state.remove()
            elif waiting:
                state.update((version, text, False))
                yield pd.DataFrame([(key[0], version, text, False)], columns=["uri", "version", "text", "closed"])
            return
        version, text, waiting = state.get if state.exists else (-1, "", False)
        closed = False
        for f in frames:
            for kind, v, t in f[["kind", "version", "text"]].itertuples(index=False):
                if v > version and (text is not None or kind == "open") or text is None and kind == "open":  # others are late
                    version, text, waiting, closed = int(v), t or "", True, kind == "close"
        if closed:
            state.update((version, None, False))
            state.setTimeoutDuration(CLOSED_MS)
            yield pd.DataFrame([(key[0], version, "", True)], columns=["uri", "version", "text", "closed"])
            return
        state.update((version, text, waiting))
        if text is None:
            state.setTimeoutDuration(CLOSED_MS)
        if waiting:
            state.setTimeoutDuration(gap_ms)

    return step


def settled(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """(uri, version, text, closed) of each document once no newer event came for gap_ms of processing time.

    events: a stream with the columns of EVENT; kinds open, change and save carry the whole text, close none."""
    return events.select("uri", "kind", "version", "text").groupBy("uri").applyInPandasWithState(
        _latest(gap_ms), "uri string, version long, text string, closed boolean", "version long, text string, waiting boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


class Publisher:
    """A foreachBatch function: findings of each settled buffer go to `sink`, (uri, version, findings) at a time.

    A buffer that does not parse repeats the last clean findings of its document; a closed one publishes none. The last
    clean findings are a table in `folder`, rewritten in a new place for each batch; after a restart the newest one of
    an earlier batch counts, so a batch that is repeated finds what it found before."""

    SCHEMA = "uri string, detector_id string, line int, message string"

    def __init__(self, sink: Callable[[DataFrame], None], folder: str):
        self.sink, self.folder = sink, folder

    def last(self, spark: SparkSession, number: int) -> str | None:
        """The table of the newest batch before `number`."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        done = [int(n[6:]) for n in names if n.startswith("clean-") and int(n[6:]) < number and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/{n}/_SUCCESS"))]
        return f"{self.folder.rstrip('/')}/clean-{max(done)}" if done else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            files = batch.where("NOT closed").select(F.col("uri").alias("path"), F.col("text").alias("source"), route(F.col("uri")).alias("language")).where("language IS NOT NULL")
            broken = units(files).where("parse_recovered").select(F.col("path").alias("uri"))
            found = scan(files).select(F.col("file").alias("uri"), "detector_id", "line", "message")
            last = self.last(spark, number)
            before = spark.read.schema(self.SCHEMA).parquet(last) if last else spark.createDataFrame([], self.SCHEMA)
            now = found.unionByName(before.join(broken, "uri", "left_semi"))
            keep = before.join(batch.select("uri").unionAll(broken).distinct().join(broken, "uri", "left_anti"), "uri", "left_anti").join(broken, "uri", "left_anti")
            path = f"{self.folder.rstrip('/')}/clean-{number}"
            keep.unionByName(now).write.mode("overwrite").parquet(path)
            clean = spark.read.schema(self.SCHEMA).parquet(path)
            rows = F.collect_list(F.when(F.col("detector_id").isNotNull(), F.struct("detector_id", "line", "message"))).alias("findings")
            self.sink(batch.select("uri", "version").join(clean, "uri", "left").groupBy("uri", "version").agg(rows))
        finally:
            batch.unpersist()
