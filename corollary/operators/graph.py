"""Bounded breadth-first traversal of edge(from, to, type), both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 3


def traverse(edges: DataFrame, start, depth: int = MAX_DEPTH, max_nodes: int | None = None) -> DataFrame:
    """(node, depth), start included at 0; no row for an unknown start. depth beyond 3 counts as 3.

    max_nodes keeps the first ones in breadth-first order: by depth, then forward neighbours before
    backward ones, in the order of the node that leads to them, then by value.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    src, dst = edges.columns[:2]
    kind = edges.schema[src].dataType
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.lit(0).alias("way")).union(edges.select(F.col(dst), F.col(src), F.lit(1)))
    known = both.where(F.col("a") == F.lit(start).cast(kind)).limit(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("depth"), F.lit("").alias("path"))
    frontier = known
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        if max_nodes is None:
            step = both.join(frontier, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct()
            step = step.join(known.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), F.lit("").alias("path"))
        else:
            # The path that leads to a node first orders nodes of one depth.
            place = F.row_number().over(Window.partitionBy("a").orderBy("way", "b"))
            step = both.distinct().join(frontier, F.col("a") == F.col("node")).withColumn("at", place)
            step = step.select(F.col("b").alias("node"), F.concat("path", F.lpad(F.col("at").cast("string"), 10, "0")).alias("path"))
            step = step.groupBy("node").agg(F.min("path").alias("path")).join(known.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "path")
        known, frontier = known.unionByName(step), step
    if max_nodes is not None:
        known = known.orderBy("depth", "path", "node").limit(max_nodes)
    return known.select("node", "depth")


def node_observations(observation: DataFrame, node, most: int | None = None) -> DataFrame:
    """(content) of the observations of a node, in order."""
    entity, content = observation.columns[:2]
    out = observation.where(F.col(entity) == F.lit(node)).select(F.col(content).alias("content")).distinct().orderBy("content")
    return out if most is None else out.limit(most)
