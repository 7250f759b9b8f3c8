"""Corpus pipeline: quality rules, line deduplication, near-duplicate removal, decontamination and encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the output of
each is written as Parquet in the shared folder and read back as the input of
the next, so a lost executor never costs more than one stage. Rows are found
again by their row key (doc_id and a digest of the text); what a stage drops
is an anti-join with the keys of the dropped, and no document is collected.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readaloud.llm.bpe import round_trip
from readaloud.llm.common import documents, row_key, stored
from readaloud.llm.decontaminate import contamination
from readaloud.llm.line_dedup import dedup_lines
from readaloud.llm.ngram_join import near_duplicates
from readaloud.llm.quality import quality_rules
from readaloud.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not among ``keys``."""
    return docs.withColumn("_key", row_key()).join(keys.select(F.col("key").alias("_key")), "_key", "left_anti").drop("_key")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs = docs.select(*COLUMNS)
    return _without(docs, stored(quality_rules(docs).where("not kept"), "rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines they share with an earlier one; those with no word left go."""
    kept = dedup_lines(docs.select(*COLUMNS)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near-duplicates."""
    docs = docs.select(*COLUMNS)
    dropped = near_duplicates(docs).where("not leads")
    keys = stored(dropped, "near-copies").select(F.col("key").alias("_key"))
    return docs.withColumn("_key", row_key()).dropDuplicates(["_key"]).join(keys, "_key", "left_anti").drop("_key")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than the allowed share of benchmark passages."""
    docs = docs.select(*COLUMNS)
    found = contamination(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _without(docs, stored(found.where("contaminated"), "contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", encode),
]

#: Patience alignment and byte-pair merges have no SQL form; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before has written."""
    docs = documents(spark, sf_dir, *COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
