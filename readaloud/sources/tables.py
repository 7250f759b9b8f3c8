"""Parquet table access.

Reads always name the columns they need so the scan's ReadSchema is pruned,
and filters are left to Catalyst to push into the Parquet reader.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def filter_computed(df: DataFrame, cond) -> DataFrame:
    """Keep rows where ``cond`` holds, with ``cond`` evaluated after the projection.

    A plain filter on a computed column is pushed by the optimizer below the
    projection that computes it, so an expensive expression (a whole text
    pipeline) would run twice. Routing the condition through an outer explode
    of a one-element array yields exactly one row per input row and a
    predicate on generator output, which stays where it is.
    """
    from pyspark.sql import functions as F
    gate = F.explode_outer(F.when(cond, F.array(F.lit(True))))
    return df.select("*", gate.alias("_keep")).where(F.col("_keep")).drop("_keep")


def read_stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a stored application table with its declared schema.

    Columns a file lacks (written before they were added) read as NULL, so
    old and new versions of a table union without a rewrite.
    """
    return spark.read.schema(schema).parquet(path)
