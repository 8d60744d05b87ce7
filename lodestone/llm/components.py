"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node with an edge can reach.

    edges has two columns of nodes; loops, repeats and nulls are dropped first.
    Alternates large and small stars (each node points its neighbours to the
    least it knows) until all components are stars. Every round is written to
    shared storage. Neighbours are never gathered: minima are aggregated and
    joined back, so a node with very many edges can be split over tasks.
    """
    a, b = edges.columns
    clean = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stars = materialise(clean, "edges")
    while True:  # the stars settle after about the squared logarithm of the nodes, at most
        inner = stars.select(F.col("v").alias("u")).distinct().join(stars.select("u"), "u", "left_semi")
        if inner.isEmpty() and not stars.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").take(1):
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        stars = materialise(_small_star(_large_star(stars)), "stars")
