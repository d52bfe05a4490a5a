"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common as C


def _settled(edges: DataFrame) -> bool:
    """True if every node has one parent and no parent has a parent."""
    up = edges.groupBy("a").agg(F.count("*").alias("n"))
    parents = edges.select(F.col("b").alias("a"), F.lit(True).alias("parent")).distinct()
    return up.join(parents, "a", "left").where("n > 1 or parent").limit(1).count() == 0


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected edges (a, b); the label is the component's least node.

    Each round joins the edges with one row per node, so a node with very many edges is split like any skewed join key. Self-links and
    repeated edges do no harm. The number of rounds grows with the logarithm of the longest path;
    each round's table is deleted once the next one is written.
    """
    now = C.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(now):
        before, now = now, C.cut(_small(_large(now)))
        C.drop(before)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
