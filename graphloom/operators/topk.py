"""The top of a graph: most linked nodes, then heaviest edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .degrees import node_degrees, node_order
from .edges import edge_order


def top_nodes(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    return node_degrees(nodes, edges).orderBy(*node_order()).limit(max(1, n))


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    keys = nodes.select("key")
    both = edges.join(keys.toDF("source_key"), "source_key", "left_semi")
    return both.join(keys.toDF("target_key"), "target_key", "left_semi")


def top_edges(named: DataFrame, selected: DataFrame, m: int) -> DataFrame:
    """The heaviest of the selected nodes' own edges: filtered first, then cut."""
    return induced_edges(named, selected).orderBy(*edge_order()).limit(max(1, m))
