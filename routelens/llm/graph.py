"""Connected components of an edge list by contraction to minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, saved


def thinned(stars: DataFrame) -> DataFrame:
    """Edges (a, b) that hang together the same nodes as stars (cls, hub), with about one for each node.

    Each node keeps the edge to its least hub; that hub is linked with the node's other hubs, which are few however many nodes
    share them. A node has at most as many hubs as keys, so no window grows with the input.
    """
    least = stars.select("cls", "hub").distinct().select("cls", "hub", F.min("hub").over(W.partitionBy("cls")).alias("least"))
    own = least.select(F.col("cls").alias("a"), F.col("least").alias("b"))
    return own.unionByName(least.select(F.col("hub").alias("a"), F.col("least").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (a node of its component) of every node of edges (a, b).

    Each round lets every node take the smallest node among its neighbours and then that one's, and contracts the edges to those
    labels; edges within a label and repeated ones go. So the graph shrinks by a share in each round: nodes are hashes, whose
    order is random. Tables are written between rounds, so joins start from plain scans and skewed ones can be split.
    """
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    names = None
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "cc-up")
        above = broadcast_if_small(up.select(F.col("node").alias("above"), F.col("up").alias("label")))
        step = saved(up.join(above, up["up"] == F.col("above")).select("node", "label"), "cc-step")
        of = lambda end, step=step: broadcast_if_small(step.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")))
        if names is None:
            names = step
        else:
            names = saved(names.join(of("to"), names["label"] == F.col("to"), "left").select("node", F.coalesce("to_label", "label").alias("label")), "cc-names")
        moved = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("x"), F.col("b_label").alias("y"))
        edges = saved(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "cc-edges")
        if edges.isEmpty():
            return names
