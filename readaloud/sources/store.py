"""A stored table as versions: every write appends a folder of the rows it adds or changes.

Nothing stored is rewritten, so a write costs what it writes however large
the table is. The table as it stands is the latest row of every id. A version is
one folder, and writing the same version again replaces it, so a write
that was lost half-way is simply repeated; versions have one writer.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .tables import read_stored


def write_version(rows: DataFrame, path: str, version: int) -> None:
    """Store ``rows`` as one version. ``rows`` may read earlier versions, but not this one."""
    rows.write.mode("overwrite").parquet(os.path.join(path, f"version={version}"))


def read_versions(spark: SparkSession, path: str, schema: StructType, upto: int | None = None) -> DataFrame:
    """All stored rows with their ``version``, read with the declared schema; columns that a version lacks are NULL.

    The bound on the version prunes folders.
    """
    rows = read_stored(spark, path, StructType([*schema.fields, StructField("version", IntegerType())]))
    return rows if upto is None else rows.where(F.col("version") <= upto)


def current(spark: SparkSession, path: str, schema: StructType, upto: int | None = None) -> DataFrame:
    """The latest row of every id, with its ``version``: the stored rows that no later version replaces.

    Only versions after the first can replace a row, so the other side of
    the anti-join has numbers alone and is as large as what was written since;
    where that is little, the first version is not shuffled. An id has at most one
    pair per version, so no id is hot. Rows that repeat an id within a version all stay; a null id is never replaced.
    """
    later = read_versions(spark, path, schema, upto).select(F.col("id").alias("_id"), F.col("version").alias("_version")).where("_version > 0")
    return read_versions(spark, path, schema, upto).join(later, (F.col("id") == F.col("_id")) & (F.col("version") < F.col("_version")), "left_anti")
