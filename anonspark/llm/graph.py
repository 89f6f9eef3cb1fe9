"""Connected components by alternating large and small stars, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the least neighbour of each node. It is stored, so that a join with it may be
    broadcast or split: the center of a star has as many edges as the star has nodes."""
    least = saved(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    return small(least, least.count())


def _stars(edges: DataFrame) -> DataFrame:
    """One large star, then one small star, of edges (a, b) with a > b. The large star makes an
    edge of each edge, so only the small star's edges are freed of repeats."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = both.join(_least(both), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    large = saved(large, "edges")
    pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
    return large.join(_least(large), "a").select(pairs.alias("e")).select("e.a", "e.b").filter("a <> b").distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether each node but the roots has one edge, to a root that has none, as at the end."""
    ends = edges.select("a", F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("out")))
    node = ends.groupBy("a").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return not node.agg(F.max(F.expr("out > 1 OR out = 1 AND least = 0"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots themselves; the root is
    the smallest node of the component. Edges with a null end, of a node with itself and
    repeated ones don't matter. Each round is written to the shared folder."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = saved(now, "edges")
    flat = now.isEmpty()
    while not flat:
        now = saved(_stars(now), "edges")
        flat = _flat(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, root) of those that roots names with more edges (a, b) between their
    nodes. Only the roots that the edges connect are walked through."""
    n = roots.count()
    for c in "ab":
        own = small(roots.select(F.col("node").alias(c), F.col("root").alias("_root")), n)
        edges = edges.join(own, c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
    more = components(edges)
    moved = roots.join(small(more.select(F.col("node").alias("root"), F.col("root").alias("_root")), more.count()), "root", "left")
    moved = moved.select("node", F.coalesce("_root", "root").alias("root"))
    return saved(moved.unionByName(more), "joined")
