"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

A star is one shuffle by node and a running window over the node's neighbours in their order, which Spark spills if they are many.
A round's result is written to the shared folder before the next round reads it; the first reads the edges once, so they needn't be
stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import durable, gathered


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v, changed) of edges(u, v), or (u, v, changed): large-star ties every larger neighbour to the smallest one, small-star
    every smaller neighbour. changed: whether any edge that it was made of was another one."""
    if "changed" not in edges.columns:
        edges = edges.withColumn("changed", F.lit(False))
    if large:
        edges = edges.select(F.inline(F.array(F.struct("u", "v", "changed"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "changed"))))
    near = Window.partitionBy("u").orderBy("v", F.desc("changed"))
    rows = edges.repartition("u").withColumns({"m": F.least("u", F.first("v").over(near)), "before": F.lag("v").over(near)})
    rows = rows.where("before is null or before <> v")  # edges that came several times stay once
    if large:
        return rows.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.expr("changed or m <> u").alias("changed"))
    return rows.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), F.expr("changed or v <> m").alias("changed"))


def below(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b) but the roots: root is the smallest node that it's linked to, directly or not."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    changed = True
    while changed:
        edges = durable(_star(_star(edges.select("u", "v"), large=True), large=False))
        rows, changed = edges.agg(F.count(F.lit(1)), F.max("changed")).first()
        edges = gathered(edges, rows)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b), roots as their own."""
    roots = below(edges)
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
