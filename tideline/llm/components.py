"""Connected components of a graph given by its links, with nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut


def _jump(parents: DataFrame) -> DataFrame:
    """Follows parents until all point at a root; each pass doubles the distance covered."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("far"))
        moved = parents.join(above, "parent", "left")
        parents = cut(moved.select("node", F.coalesce("far", "parent").alias("parent"), F.col("far").isNotNull().alias("moved")))
        if parents.where("moved").isEmpty():
            return parents.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link; root is the same throughout a component. links: columns a and b.

    Every node takes its smallest neighbour below it as parent, chains are followed to their roots, and the links between
    roots are the next, smaller graph. Links from a node to itself, nulls and repeated links make no difference.
    """
    links = cut(links.select("a", "b").where("a <> b").distinct())
    found = None
    while not links.isEmpty():
        ends = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
        parents = _jump(cut(ends.groupBy("node").agg(F.min("parent").alias("parent"))))
        if found is None:
            nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            found = nodes.join(parents, "node", "left").select("node", F.coalesce("parent", "node").alias("root"))
        else:
            above = parents.withColumnRenamed("node", "root")
            found = found.join(above, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        found = cut(found)
        for end in ("a", "b"):
            above = parents.select(F.col("node").alias(end), F.col("parent").alias("above"))
            links = links.join(above, end, "left").withColumn(end, F.coalesce("above", end)).drop("above")
        links = cut(links.where("a <> b").distinct())
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
