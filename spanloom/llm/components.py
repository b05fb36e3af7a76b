"""Connected components by alternating large-star and small-star steps, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.store import discard, materialize, tasks_for


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, component): component is the smallest node that links reach.

    Every node of a link gets a row. Each round is two aggregations by node, with map-side
    minimum; the round's links are written to the shared folder, and only whether they are stars
    reaches the driver. A round makes no more links than it has read, so equal ones are merged at the
    end alone. A node with very many links is the smaller end of its star and so is summed
    up, never gathered. Nulls and loops link nothing; without links the result is empty.
    """
    edges = materialize(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while not _stars(edges):
        tasks = tasks_for(edges)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: a node's larger neighbours move to the smallest of all
        large = materialize(edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks), "large")
        # small star: a node and its smaller neighbours move to the smallest of these, the node where its link to that one stood
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        old, edges = edges, materialize(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).coalesce(tasks), "edges")
        discard(old, large)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
    labels = materialize(nodes.distinct().coalesce(tasks_for(edges)), "labels")
    discard(edges)
    return labels


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on nothing: then roots are the smallest of their components."""
    ends = edges.select(F.col("u").alias("node"), "v", F.lit(False).alias("down")).union(edges.select("v", F.lit(None), F.lit(True)))
    odd = ends.groupBy("node").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("down").alias("down")).where("least < most OR (least IS NOT NULL AND down)")
    return odd.isEmpty()
