"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.llm.common import discard, written


def _between(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root): each node hooks to its smallest neighbour if that is smaller; the root is where this ends.

    Hooks only go down, so they make a forest; pointers are doubled until none moves.
    """
    both = edges.union(edges.select("b", "a"))
    up = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooks")
    while True:
        over = up.select(F.col("node").alias("at"), F.col("root").alias("over"))
        jumped = written(up.join(over, up["root"] == over["at"]).select("node", F.col("over").alias("root"), (F.col("over") != F.col("root")).alias("moved")), "hooks")
        discard(up)
        up = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return up


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); a component is its smallest node.

    Each round replaces the nodes by their roots and keeps the distinct edges between different roots,
    so that the edges that are joined shrink from round to round. Tables between rounds are written to the shared folder.
    """
    edges = written(_between(edges), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    first = True
    while not edges.isEmpty():
        roots = _roots(edges)
        if first:
            labels, first = roots.withColumnRenamed("root", "component"), False
        else:
            old = labels
            labels = written(old.join(roots, old["component"] == roots["node"], "left").select(old["node"], F.coalesce("root", "component").alias("component")), "labels")
        of_a, of_b = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
        left = written(_between(edges.join(of_a, "a").join(of_b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "edges")
        discard(edges)
        edges = left
    return labels


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, part) after ``links`` (a, b) between parts; a node that is not in ``parts`` is a part of its own."""
    found = connected(links)
    moved = parts.join(found.toDF("part", "component"), "part", "left").select("node", F.coalesce("component", "part").alias("part"))
    new = found.join(parts.select("node"), "node", "left_anti").select("node", F.col("component").alias("part"))
    return written(moved.union(new), "parts")
