"""Token counts with a digest cache.

A count is stored under the digest of the content and the digest of the
tokenizer's file, so equal texts are encoded once and a changed vocabulary starts afresh.

1. Every text gives (size, digest); equal digests meet after a map-side
   aggregate, so a text that fills a third of the table leaves each task once.
2. Distinct digests that the cache doesn't hold are encoded in batches.
3. Their counts are appended to the cache, and every document finds its
   count by its digest. That join carries digests only, no text, and both sides are plain
   exchanges, so adaptive execution can split a digest of very many documents.

Normalisation is null to the empty text and nothing more: any other change of
the content could change its count. Rows that repeat keep their own result
rows; an empty table gives an empty result and an unchanged cache; other
columns are ignored. A task that is run again appends nothing twice (Spark
commits a write as a whole), and a digest that two runs appended counts once.
"""
from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, shipped, stored, text_or_empty

CACHE = T.StructType([T.StructField("version", T.StringType()), T.StructField("digest", T.BinaryType()),
                      T.StructField("n_tokens", T.LongType())])
#: Texts handed to the tokenizer at once, by characters.
BATCH_CHARS = 1 << 20


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, path: str, tokenizer_version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; empty if nothing was stored yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    held = spark.read.schema(CACHE).parquet(path).where(F.col("version") == tokenizer_version)
    return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text)."""
    def run(batches: Iterator[pa.RecordBatch]):
        encode = tokenizer(path).encode_batch_fast
        for batch in batches:
            counts, held, size = [], [], 0
            for text in batch.column(1):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= BATCH_CHARS:
                    counts += [len(e) for e in encode(held, add_special_tokens=False)]
                    held, size = [], 0
            counts += [len(e) for e in encode(held, add_special_tokens=False)] if held else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
    return shipped(texts).mapInArrow(run, "digest binary, n_tokens bigint")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; without a cache path a new cache is started in the shared folder."""
    spark = docs.sparkSession
    cache_path = cache_path or shared_path(spark, "token-cache")
    number = version(tokenizer_path)
    text = text_or_empty()
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    held = read_cache(spark, cache_path, number)
    distinct = docs.select(digest, text.alias("text")).dropDuplicates(["digest"])
    misses = distinct.join(held.select("digest"), "digest", "left_anti").select("digest", "text")
    fresh = encode_misses(misses, tokenizer_path)
    fresh.select(F.lit(number).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = stored(read_cache(spark, cache_path, number), "token-counts")
    rows = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), digest)
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
