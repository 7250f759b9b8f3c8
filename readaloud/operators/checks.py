"""Constraint checks as report queries (Spark enforces none of them)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, child_key: str, fk: str, parent: DataFrame, parent_key: str, relation: str) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent row (left anti join)."""
    c = child.where(F.col(fk).isNotNull()).select(F.col(child_key).alias("child_id"), F.col(fk).alias("parent_id"))
    p = parent.select(F.col(parent_key).alias("parent_id"))  # a primary key
    return c.join(p, "parent_id", "left_anti").select(F.lit(relation).alias("relation"), "child_id", "parent_id")


def length_violations(df: DataFrame, table: str, key: str, limits: dict[str, int]) -> DataFrame:
    """Values longer than the declared column length, one row per violation."""
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.length(F.col(c)).cast("bigint").alias("length"),
                              F.lit(n).cast("bigint").alias("max_length")) for c, n in limits.items() if c in df.columns])
    return df.select(F.lit(table).alias("table_name"), F.col(key).cast("bigint").alias("row_id"),
                     F.inline(F.filter(each, lambda x: x["length"] > x["max_length"])))


def null_violations(df: DataFrame, table: str, key: str, column: str) -> DataFrame:
    return df.where(F.col(column).isNull()).select(F.lit(table).alias("table_name"), F.col(key).cast("bigint").alias("row_id"),
                                                   F.lit(column).alias("column_name"))


def unique_violations(df: DataFrame, column: str) -> DataFrame:
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))
