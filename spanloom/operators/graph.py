"""Entities that links connect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.storage import written


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, component), the smallest node that links reach.

    Labels go along the links, and each label then takes on the label of the node that it names, so that long
    chains close in few rounds. A round is two aggregations with map-side minimum; a node of very many links is summed up.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    both = written(both, "links")
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        least = labels.join(heard, "node").select("node", F.least("component", "heard").alias("component"), F.col("component").alias("was"))
        root = least.select(F.col("node").alias("component"), F.col("component").alias("root"))
        after = written(least.join(root, "component", "left").select("node", F.least("component", F.coalesce("root", "component")).alias("component"), "was"), "labels")
        moved = after.where("component <> was").limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            return labels


def canonical(members: DataFrame, labels: DataFrame, node: str, preferred: Column, order: Column) -> DataFrame:
    """Each member's canonical one: the first preferred member of its component, or the first of all. Members without links are their own."""
    named = members.join(labels.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))
    first = named.groupBy("component").agg(F.min(F.struct((~preferred).alias("p"), order.alias("o"), F.col(node).alias("n")))["n"].alias("canonical"))
    return named.join(first, "component").select(node, "canonical")
