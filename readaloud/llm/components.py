"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregates and two joins over the edges, written to the
shared folder, so lineage stays short and nothing is gathered in one place. A
node with very many edges is a hot key of the join: its minimum sits in a table of its own, and both
sides are plain exchanges, which adaptive execution can split. Rounds end when
the edges are disjoint stars, which one aggregate tells.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node moves to the least node around it."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = stored(around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")), "star-minima")
    moved = around.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return stored(moved.where("u != v"), "edges")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours move to the least of them."""
    lows = stored(edges.groupBy("u").agg(F.min("v").alias("low")), "star-minima")
    moved = edges.join(lows, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return stored(moved.unionByName(lows.select("u", F.col("low").alias("v"))).distinct(), "edges")


def _disjoint_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up or only edges down."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    mixed = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
    return mixed.agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least node of each node's component; nodes without an edge are absent."""
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "edges")
    if not _disjoint_stars(edges):
        edges = _small_star(edges)
    while not _disjoint_stars(edges):
        edges = _small_star(_large_star(edges))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
