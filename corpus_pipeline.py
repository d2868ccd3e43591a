"""From raw documents to sharded training data, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, all but the last with the columns of
documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescore.llm import quality
from pagescore.llm.common import discard, table, unsigned_crc32, written
from pagescore.llm.decontaminate import hits
from pagescore.llm.jaccard import similar_groups
from pagescore.llm.mixing import in_training_order, mix, word_count
from pagescore.llm.sharding import shard

N_SHARDS = 24


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more stay. The model learns from labelled ones, the fold mod 3 = 1 left out."""
    return quality.accepted(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def unused(name: str, docs: DataFrame) -> str:
    """A name that no column of the documents has, however it is written."""
    taken = {c.lower() for c in docs.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, source and the whole row as a struct `_row`, so that no other column can clash with those that an operator adds."""
    return docs.select("doc_id", "source", F.struct(*docs.columns).alias("_row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id stays.

    Equal rows stay once; rows that repeat that doc_id with another text stay. A row without doc_id takes part under a
    number made from its text, greater than the ids of the table, so that it stays only if no linked row has an id.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))
    own = unused("id", docs)
    groups = similar_groups(docs.select(number.alias("doc_id"), "text"))
    kept = written(groups.where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct(), "kept")
    numbered = docs.withColumn(own, number)
    return numbered.join(kept, own, "left_semi").dropDuplicates([own, "text"]).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item's window occurs go."""
    doc, text_hash = unused("doc", docs), unused("text_hash", docs)
    found = hits(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text").select(F.col("_doc").alias(doc), F.col("_text_hash").alias(text_hash))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_hash)), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each take; those not taken go. A take in part, the last of a source, stays whole."""
    kept = wrapped(docs)
    mixed = mix(kept.withColumn("_size", word_count(F.col("_row.text"))), "doc_id", "_size")
    return in_training_order(mixed).select("_row.*")


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot."""
    placed = shard(wrapped(docs).withColumn("_crc", unsigned_crc32(F.col("_row.text"))), "doc_id", ["_crc"], N_SHARDS)
    return placed.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")], "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", reject_low_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("source_mixing", mix_sources),
    ("sharding", deal_to_shards),
]

#: The classifier has no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the table documents."""
    docs = before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, table(spark, sf_dir, "documents") if before is None else before, sf_dir), name)
        if before is not None:
            discard(before)  # the next stage's table holds all that is needed of it
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
