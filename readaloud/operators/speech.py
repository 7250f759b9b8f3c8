"""Text-to-speech preparation as a DataFrame transform.

``prepare_speech`` is the full text pipeline for one row: basic clean,
speech formatting, title prefix, word count and chunk list. All of it is
row-local, so it runs in the scan's stage with no shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import NO_TEXT_ERROR
from ..functions.text import basic_clean, format_for_speech, prefix_title, word_count
from .chunks import chunk_text


def prepare_speech(df: DataFrame, text: str = "original_text", title: str = "title",
                   keep_clean: bool = False) -> DataFrame:
    """Add ``processed_text``, ``word_count`` and ``chunks``.

    An empty or NULL input gives NULL outputs (nothing to process). The pause
    step in speech formatting never fires here because whitespace was already
    collapsed; that order is kept as is.
    """
    empty = F.col(text).isNull() | (F.col(text) == "")
    out = df.withColumn("clean_text", F.when(empty, F.lit(None)).otherwise(basic_clean(F.col(text))))
    out = out.withColumn("processed_text",
                         F.when(empty, F.lit(None))
                         .otherwise(prefix_title(F.col(title), format_for_speech(F.col("clean_text")))))
    out = out.withColumn("word_count", F.when(empty, F.lit(None)).otherwise(word_count(F.col("processed_text"))))
    out = out.withColumn("chunks", F.when(empty, F.lit(None)).otherwise(chunk_text(F.col("processed_text"))))
    return out if keep_clean else out.drop("clean_text")


def with_synthesis_error(jobs: DataFrame) -> DataFrame:
    """Keep an extraction error; otherwise a job whose speech text is empty fails
    at synthesis ("no text"). Jobs with ``error`` NULL have synthesis input."""
    empty = F.coalesce(F.col("processed_text"), F.lit("")) == ""
    return jobs.withColumn("error", F.coalesce(F.col("error"), F.when(empty, F.lit(NO_TEXT_ERROR))))
