"""From references to weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_COLUMNS = ("key", "name", "kind", "group_path", "package_references", "representative_file")


def weighted_edges(references: DataFrame, nodes: DataFrame, drop_self_edges: bool = False) -> DataFrame:
    """``(source_key, target_key, count)`` of the references whose target is a node; repeated ones add weight.

    The references are counted by pair before they meet the nodes, so the
    join sees one row for each pair.
    """
    pairs = references.groupBy("source_key", "target_key").agg(F.count(F.lit(1)).alias("count"))
    if drop_self_edges:
        pairs = pairs.where("source_key <> target_key")
    return pairs.join(nodes.select(F.col("key").alias("target_key")), "target_key", "left_semi").select("source_key", "target_key", "count")


def reference_counts(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: external (target unknown) and conditional references; the latter before resolution."""
    pairs = references.groupBy("target_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_conditional")).alias("conditional")
    )
    known = nodes.select(F.col("key").alias("target_key"), F.lit(True).alias("known")).distinct()
    joined = pairs.join(known, "target_key", "left")
    return joined.agg(
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("external_references"),
        F.coalesce(F.sum("conditional"), F.lit(0)).alias("conditional_references"),
    )


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both names."""
    names = nodes.select("key", "name")
    source = names.toDF("source_key", "source_name")
    target = names.toDF("target_key", "target_name")
    return edges.join(source, "source_key").join(target, "target_key").select("source_key", "target_key", "source_name", "target_name", "count")



def edge_order() -> list:
    return [F.desc("count"), F.asc("source_name"), F.asc("target_name"), F.asc("source_key"), F.asc("target_key")]
