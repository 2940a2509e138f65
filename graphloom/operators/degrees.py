"""Degrees, hubs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.options import HUBS


def degrees(edges: DataFrame) -> DataFrame:
    """``(key, outgoing, incoming)`` by summed weight, for keys with an edge; a self-edge counts on both sides."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("source_key").alias("key"), F.col("count").alias("o"), F.lit(0).cast("long").alias("i")),
                F.struct(F.col("target_key").alias("key"), F.lit(0).cast("long").alias("o"), F.col("count").alias("i")),
            )
        ).alias("e")
    )
    return ends.groupBy("e.key").agg(F.sum("e.o").alias("outgoing"), F.sum("e.i").alias("incoming"))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes with their degrees, 0 where they have no edge."""
    return nodes.join(degrees(edges), "key", "left").fillna(0, ["outgoing", "incoming"])


def node_order() -> list:
    """Most edges first, then most packages, then name and key."""
    return [F.desc(F.col("outgoing") + F.col("incoming")), F.desc("package_references"), F.asc("name"), F.asc("key")]


def hubs(nodes: DataFrame, edges: DataFrame, n: int = HUBS) -> DataFrame:
    return node_degrees(nodes, edges).orderBy(*node_order()).limit(n)


def kind_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "kind")


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, summed weight, different edges, packages and test projects."""
    n = nodes.agg(
        F.count(F.lit(1)).alias("project_count"),
        F.coalesce(F.sum("package_references"), F.lit(0)).cast("long").alias("total_package_references"),
        F.count_if(F.col("kind") == "test").alias("test_project_count"),
    )
    e = edges.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_dependencies"), F.count(F.lit(1)).alias("edge_count"))
    # Two rows of aggregates, one each.
    return n.join(e, F.lit(True))
