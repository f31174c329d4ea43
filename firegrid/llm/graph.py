"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.session import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest vertex of its neighbourhood."""
    e = _both(edges)
    least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return e.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the smallest of these."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    tied = e.join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")
    return tied.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no vertex is tied to two smaller ones, or to a smaller and a larger one. ``edges``: distinct, ``a < b``."""
    ends = edges.select(F.col("a").alias("id"), F.lit(0).alias("tied")).unionByName(edges.select(F.col("b").alias("id"), F.lit(1).alias("tied")))
    met = ends.groupBy("id").agg(F.sum("tied").alias("n"), F.min("tied").alias("least"))
    return met.where("n > 1 OR n = 1 AND least = 0").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every end of an edge (``a``, ``b``, any order); a component is named by its smallest id.

    The rounds grow with the logarithm of a component's size; edges that are stars already need none. A hub is never gathered:
    minima are combined before the shuffle, and joins can be split. Each round is checkpointed. Loops and rows with a NULL
    end are ignored.
    """
    e = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not _are_stars(e):
        e = cut_lineage(_small_star(_large_star(e)))
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
