"""A training corpus from raw documents: known language, one of each near-duplicate group, no benchmark leaks, no
personal data, encoded. STAGES are functions (spark, docs, sf_dir) -> DataFrame; each is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissona.llm import bpe_codec, decontaminate, language_id, minhash_dedup, pii
from dissona.llm.shared import stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no language is likely for, go; without labelled rows only the former."""
    return language_id.known_language(docs, language_id.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts (five-word shingles, similarity 0.8) the row with the smallest doc_id stays.

    Rows that repeat a doc_id, or have none, are told apart by their texts: only the same text, or a linked one, makes
    them copies. Of rows that are equal in both one stays, the first in the order of its JSON form."""
    key = free(docs, "key")
    many = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id")
    if many.isEmpty():
        found = minhash_dedup.near_duplicates(docs, n=5, threshold=80)
        return docs.join(found.where("NOT kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    flag = free(docs, "many")
    many = many.select(F.col("doc_id").alias(flag + "_id"), F.lit(True).alias(flag))
    rows = docs.join(many, docs["doc_id"].eqNullSafe(many[flag + "_id"]), "left")
    rows = stored(rows.select(docs["*"], flag, F.when(F.col(flag), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")).alias(key)), "keyed")
    found = stored(minhash_dedup.near_duplicates(rows, key=key, n=5, threshold=80).select(key, "component_id").distinct(), "found")
    best = found.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("best"))
    left = rows.join(best.select(F.col(f"best.{key}").alias(key)), key, "left_semi")
    all_ = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = left.where(flag).groupBy(key).agg(F.min_by(all_, F.to_json(all_)).alias(flag)).select(f"{flag}.*")
    return left.where(F.col(flag).isNull()).select(docs.columns).unionAll(once)


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    names = {c.lower() for c in docs.columns}
    while name in names or f"{name}_id" in names:
        name += "_"
    return name


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is masked."""
    return pii.redact(docs, pii.fit(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of each document."""
    return bpe_codec.encode(docs, TOKENIZER)


STAGES = [
    ("language_id", known_language),
    ("minhash_dedup", one_of_each),
    ("decontaminate", no_benchmark),
    ("pii", no_personal_data),
    ("bpe_codec", encoded),
]
ORACLE_SQL = None  # learnt models and encodings: SQL can't express them; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
