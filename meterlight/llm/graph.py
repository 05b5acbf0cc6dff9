"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import held_narrow


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id reachable.

    ``links`` and ``known`` are written tables. ``known`` are the components (id, component) of
    earlier links; the new ones are then read as links between those components, so a few new
    links cost little.

    Every id hooks onto its smallest smaller neighbour. That makes trees, which pointer jumping
    flattens in the logarithm of their depth. Links between different trees go on as links of
    their roots, until none is left; where every id had one smaller neighbour, none is. Each
    step is a written table; a hub's neighbours are joined with its root, never gathered.
    """
    rows = links.count()
    labels = None if known is None else known.where("id != component")
    edges = held_narrow(_between(links, known), "links", rows)
    while (open_edges := edges.count()) > 0:
        trees = _flattened(held_narrow(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "links", open_edges))
        hooked = trees.count()
        if labels is None:
            labels = trees
        else:
            # What hung on a root that has hooked onto another one moves along.
            root = trees.select(F.col("id").alias("component"), F.col("component").alias("to"))
            moved = labels.join(root, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            labels = held_narrow(moved.unionByName(trees), "links", labels.count() + hooked)
        if hooked == open_edges:
            break
        edges = held_narrow(_between(edges.select(F.col("u").alias("a"), F.col("v").alias("b")), trees), "links", open_edges)
    if labels is None:
        return links.sparkSession.createDataFrame([], "id long, component long")
    return labels.unionByName(labels.select(F.col("component").alias("id"), "component").distinct())


def apart(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links (a, b) whose ends lie in different components, with those as of_a and of_b."""
    a, b = (labels.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    both = links.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b"))
    return both.where("of_a != of_b")


def _between(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Different links (u, v), u > v, between the components of the given ones."""
    ends = links.where("a != b").select("a", "b") if labels is None else apart(links, labels).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _flattened(parents: DataFrame) -> DataFrame:
    """(id, component) with the root of each id's tree, from its parent, which is smaller."""
    rows = parents.count()
    while True:
        above = parents.select(F.col("id").alias("component"), F.col("component").alias("to"))
        step = parents.select("id", "component").join(above, "component", "left")
        parents = held_narrow(step.select("id", F.coalesce("to", "component").alias("component"), F.col("to").isNotNull().alias("moved")), "links", rows)
        if parents.where("moved").isEmpty():
            return parents.select("id", "component")
