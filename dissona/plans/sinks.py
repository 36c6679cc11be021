"""Findings as JSON lines, as SARIF results, as diagnostics, and the exit policy."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.functions.strings import lookup, severity_rank

LEVELS = {"info": "none", "note": "note", "warning": "warning", "error": "error"}
DIAGNOSTIC = {"info": "HINT", "note": "INFORMATION", "warning": "WARNING", "error": "ERROR"}
LOCATION = "struct<file:string,start_line:int,start_col:int,end_line:int,end_col:int>"
FINDING = f"detector_id string, primary {LOCATION}, related array<{LOCATION}>, message string, severity string, anomaly_class string, citations array<string>, evidence string"


def region(p: Column) -> Column:
    return F.struct(
        F.struct(p["file"].alias("uri")).alias("artifactLocation"),
        F.struct(p["start_line"].alias("startLine"), p["start_col"].alias("startColumn"), p["end_line"].alias("endLine"), p["end_col"].alias("endColumn")).alias("region"),
    )


def json_lines(findings: DataFrame) -> DataFrame:
    """(json): one object for each finding, without null fields."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(result): a SARIF 2.1.0 result object for each finding; optional columns posterior_tp, lower, rank_score are properties."""
    extra = [c for c in ("posterior_tp", "lower", "rank_score") if c in findings.columns]
    place = F.array(F.struct(region(F.col("primary")).alias("physicalLocation")))
    related = F.transform("related", lambda r: F.struct(region(r).alias("physicalLocation")))
    fields = [F.col("detector_id").alias("ruleId"), lookup(LEVELS, F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), related.alias("relatedLocations")]
    if extra:
        fields.append(F.struct(*extra).alias("properties"))
    return findings.select(F.to_json(F.struct(*fields)).alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str, version: str, rules: list[dict] | None) -> int:
    """One document for a reader outside Spark; results stream to the driver one partition at a time. rules None: left out."""
    driver = {"name": tool, "version": version} | ({"rules": rules} if rules is not None else {})
    head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"})[:-1]
    n = 0
    with Path(path).open("w") as f:
        f.write(f'{head}, "runs": [{{"tool": {{"driver": {json.dumps(driver)}}}, "results": [')
        for r in sarif_results(findings).toLocalIterator():
            f.write((",\n" if n else "\n") + r["result"])
            n += 1
        f.write("\n]}]}\n")
    return n


def diagnostics(findings: DataFrame) -> DataFrame:
    """(uri, range, severity, code, message): positions from 0."""
    zero = lambda c: F.greatest(F.col(f"primary.{c}") - 1, F.lit(0))
    span = F.struct(*[zero(c).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")])
    return findings.select(F.col("primary.file").alias("uri"), span.alias("range"), lookup(DIAGNOSTIC, F.col("severity")).alias("severity"), F.col("detector_id").alias("code"), "message")


def fails(findings: DataFrame, threshold: str) -> bool:
    """Whether any finding is as severe as the threshold; 'never': no."""
    return threshold != "never" and not findings.where(severity_rank(F.col("severity")) >= F.lit({"info": 0, "note": 1, "warning": 2, "error": 3}[threshold])).isEmpty()


def summary(findings: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """(detector_id, n, lower): counts with the prior's lower bound where there is one."""
    n = findings.groupBy("detector_id").agg(F.count("*").alias("n"))
    return n.join(priors.select("detector_id", "lower"), "detector_id", "left") if priors is not None else n.withColumn("lower", F.lit(None).cast("double"))
