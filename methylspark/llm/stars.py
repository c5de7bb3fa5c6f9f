"""Connected components of a table of links by alternating large-star and small-star.

Large-star: every node links its larger neighbours to the least of itself and all its
neighbours. Small-star: every node links its smaller neighbours, and itself, to the least of
them. Both keep components as they are, and in turn they make every component a star around its
least node; then neither changes anything and the links are the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_size, staged, unstage


def large_star(links: DataFrame) -> DataFrame:
    """From links ``a < b`` the links ``a < b`` of a large-star step; one may occur more than once."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).filter("least < u")
    moved = join_by_size(links, least.withColumnRenamed("u", "a"), ["a"], "n", 2 * links.count(), "left")
    return moved.select(F.coalesce("least", "a").alias("a"), "b")


def small_star(links: DataFrame) -> DataFrame:
    """From links ``a < b`` the distinct links ``a < b`` of a small-star step."""
    least = staged(links.groupBy("b").agg(F.min("a").alias("least"), F.count("*").alias("n")), "least-neighbours")
    own = least.select(F.col("least").alias("a"), "b")
    others = join_by_size(links, least.filter("n > 1"), ["b"], "n", links.count(), "inner").filter("a <> least")
    return own.union(others.select(F.col("least").alias("a"), F.col("a").alias("b"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is either the lesser end of its links or the greater end of a single one."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(1).alias("up")))).alias("e"))
    ups = ends.groupBy("e.node").agg(F.sum("e.up").alias("n"), F.min("e.up").alias("least"))
    return ups.filter("n > 1 OR n = 1 AND least = 0").isEmpty()


def star_step(links: DataFrame) -> DataFrame:
    """One large-star and one small-star of ``links`` (columns ``a, b``), written; null ends and loops are left out."""
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("__differ"))
    edges = staged(ordered.filter("__differ").select("a", "b").distinct(), "star-links")
    large = staged(large_star(edges), "large-star")
    small = staged(small_star(large), "small-star")
    unstage(edges, large)
    return small


def near_roots(links: DataFrame) -> DataFrame:
    """``node, root`` from links ``a < b``: the least neighbour of each node that has a lesser one. Nodes of one root are in one component; the reverse holds for stars only."""
    return links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def star_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``); the root is the component's least node.

    Null ends and loops are ignored, repeated links count once, and without links there are no rows. A node with
    a large share of all links is joined by a broadcast (``join_by_size``), its minimum is pre-aggregated, so
    its links are never one task's work.
    """
    edges = star_step(links)
    while not _are_stars(edges):
        more = star_step(edges)
        unstage(edges)
        edges = more
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
