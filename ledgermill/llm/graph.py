"""Connected components of a staged edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.shared import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node in edges (a, b: of one type with an order).

    Each round points every node to its smallest neighbour, follows the pointers twice and contracts
    the edges onto the nodes pointed to; at least half of the nodes with edges go in a round. Tables
    are staged between rounds, and nothing but "are edges left" reaches the driver.
    """
    edges = stage(edges.where("a <> b").select("a", "b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")))
        for _ in range(2):
            parent = stage(_relabel(parent, "p", parent))
        labels = parent.select(F.col("a").alias("node"), F.col("p").alias("root")) if labels is None else _relabel(labels, "root", parent)
        labels = stage(labels)
        edges = stage(_relabel(_relabel(edges, "a", parent), "b", parent).where("a <> b").distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _relabel(rows: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    to = parent.select(F.col("a").alias("from_node"), F.col("p").alias("to_node"))
    joined = rows.join(to, F.col(column) == F.col("from_node"), "left")
    return joined.select(*(F.coalesce("to_node", column).alias(column) if c == column else F.col(c) for c in rows.columns))
