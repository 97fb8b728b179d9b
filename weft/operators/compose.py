"""Labels composed along every simple path of a graph, from its roots to a fixed point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_counted


def compose(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """node, labels, nodes: for every path from a root that visits no node twice, its labels and its nodes, the root first.

    edges: parent, child, label. Roots (node) default to the parents that are nobody's child; a root's own path has no
    labels. Unlike reachability, which keeps a node once, each path counts: values add up along it. Every round extends the
    paths that the round before found, by a join with the edges, and ends their lineage; a path that would return to one of its
    own nodes ends there, so cycles end too. Equal edges are one; null ends lead nowhere."""
    edges = cut(edges.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child", "label").distinct())
    if roots is None:
        roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    none = F.array().cast("array<string>")
    frontier, n = cut_counted(roots.select("node").distinct().select("node", none.alias("labels"), F.array("node").alias("nodes")))
    out = frontier
    while n:
        step = frontier.join(edges, F.col("node") == F.col("parent")).where(~F.array_contains("nodes", F.col("child")))
        frontier, n = cut_counted(step.select(F.col("child").alias("node"), F.concat("labels", F.array(F.col("label").cast("string"))).alias("labels"), F.concat("nodes", F.array("child")).alias("nodes")))
        if n:
            out = out.unionByName(frontier)
    return out
