"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import FILE_ROWS, join_groups, keep


def connected_components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    A large-star step hangs every larger neighbour of a node on the smallest one around it, a small-star step does so
    with the smaller neighbours; each step is one aggregation and one join over the edges, both safe with hub nodes. The
    steps end when every edge leads straight to its component's smallest node. Each table is written to the shared folder."""
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    n = now.count()
    now = now.coalesce(n // FILE_ROWS + 1)
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = keep(_star(both, "b > a", 2 * n), label, n)
        now = keep(_star(large, "b <= a", n), label, n)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _all_stars(edges: DataFrame) -> bool:
    """Whether every larger node has one edge, and the nodes that edges lead to have none onwards."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def _star(edges: DataFrame, which: str, n: int) -> DataFrame:
    """Each node's neighbours (those that ``which`` names), and the node itself, hung on the smallest of them all."""
    least = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"), F.count(F.lit(1)).alias("n"))
    hung = join_groups(edges, least, "a", "n", n).where(which).select(F.col("b").alias("a"), F.col("least").alias("b"))
    if which == "b <= a":
        hung = hung.unionByName(least.select("a", F.col("least").alias("b")))
    return hung.where("a <> b").distinct()
