"""Language identification: train on one half of the labelled documents, score every document."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basic_clean
from ..operators.language import LanguageModel, detect, train
from ..sources.tables import read_table


def _fitted(doc_id: Column) -> Column:
    return F.substring(F.md5(doc_id.cast("string")), 1, 1) < "8"


def trained_on_documents(spark: SparkSession, sf_dir: str) -> LanguageModel:
    """The model of the documents' training half."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang").where(_fitted(F.col("doc_id")))
    return train(d.select("lang", basic_clean(F.col("text")).alias("text")))


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected language of every document, its label, and whether the model was fitted on it.

    The training half is picked by a digest of the document number.
    """
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    clean = d.select("doc_id", "lang", _fitted(F.col("doc_id")).alias("fitted"), basic_clean(F.col("text")).alias("text"))
    return detect(clean, train(clean.where("fitted")))


def language_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label, on documents the model was and was not fitted on: how many were detected as it."""
    r = language_detect(spark, sf_dir)
    return r.groupBy("lang", "fitted").agg(F.count(F.lit(1)).alias("n_docs"),
                                           F.count(F.when(F.col("detected") == F.col("lang"), 1)).alias("n_correct"))
