"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``).

    Each round every node takes, among itself and its neighbours, the one of least
    hash; the links are then rewritten between those and loops are dropped. Rounds grow
    with the logarithm of the number of nodes. A node with very many neighbours is only
    ever a key of a map-side minimum. Null ends and loops are ignored.
    """
    edges = staged(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links"
    )
    labels = staged(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    while not edges.isEmpty():
        ordered = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("v", "u")
        best = staged(both.groupBy("v").agg(F.min(F.least(ordered("v"), ordered("u"))).alias("m")).select("v", F.col("m.n").alias("p")), "parents")
        jump = best.select(F.col("v").alias("p"), F.col("p").alias("q"))
        up = staged(best.join(jump, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "parents")
        old = [edges, labels, best, up]
        labels = staged(labels.join(up, labels.root == up.v, "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        moved = edges.join(up.toDF("a", "pa"), "a").join(up.toDF("b", "pb"), "b")
        edges = staged(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct(), "links")
        unstage(*old)
    return labels
