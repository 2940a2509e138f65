"""What a reader of a finished report asks: neighbours, cycles, counts and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import cycle_label


def neighbourhood_edges(edges: DataFrame, key) -> DataFrame:
    """All edges, marked as related if the node is one of their ends, else dimmed."""
    related = (F.col("source_key") == F.lit(key)) | (F.col("target_key") == F.lit(key))
    return edges.withColumn("is_related", related).withColumn("is_dimmed", ~related)


def neighbourhood_nodes(nodes: DataFrame, edges: DataFrame, key) -> DataFrame:
    """All nodes, marked as selected, related (an end of an incident edge) or dimmed."""
    near = edges.where((F.col("source_key") == F.lit(key)) | (F.col("target_key") == F.lit(key)))
    ends = near.select(F.explode(F.array("source_key", "target_key")).alias("key")).distinct().withColumn("near", F.lit(True))
    marked = nodes.join(ends, "key", "left")
    chosen = F.col("key") == F.lit(key)
    return marked.select(
        *[c for c in nodes.columns],
        chosen.alias("is_selected"),
        (F.coalesce("near", F.lit(False)) & ~chosen).alias("is_related"),
        (~F.coalesce("near", F.lit(False)) & ~chosen).alias("is_dimmed"),
    )


def incident_edge_counts(edges: DataFrame) -> DataFrame:
    """``(key, incident_edges)``; a self-edge counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source_key", "target_key"))).alias("key"))
    return ends.groupBy("key").agg(F.count(F.lit(1)).alias("incident_edges"))


def cycle_highlight(named: DataFrame, members: list[str]) -> DataFrame:
    """Edges whose ends' names are both in the cycle; equal names all light up."""
    inside = F.array(*map(F.lit, members)) if members else F.array().cast("array<string>")
    return named.where(F.array_contains(inside, F.col("source_name")) & F.array_contains(inside, F.col("target_name")))


def cycle_list(cycles: DataFrame) -> DataFrame:
    """Sidebar labels in the cycles' order."""
    return cycles.select("rank", cycle_label(F.col("scope"), F.col("length"), F.col("nodes")).alias("label"))


def counted(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def status_text(nodes: Column, edges: Column, cycles: Column, granularity: str) -> Column:
    """The status line of a graph."""
    found = F.concat(F.lit(f"{granularity.capitalize()} graph: "), counted(nodes), F.lit(" node(s), "), counted(edges), F.lit(" dependency edge(s)."))
    more = F.concat(F.lit(" "), counted(cycles), F.lit(" circular dependency group(s) highlighted in red."))
    return F.when(cycles > 0, F.concat(found, more)).otherwise(found)


def summary_text(nodes: Column, edges: Column, cycles: Column) -> Column:
    return F.concat(counted(nodes), F.lit(" node(s), "), counted(edges), F.lit(" edge(s), "), counted(cycles), F.lit(" cycle(s)."))


def selection_text(name: Column, incident: Column) -> Column:
    """What is said when a node is selected."""
    shown = F.when(F.coalesce(name, F.lit("")) == "", "Node").otherwise(name)
    return F.concat(shown, F.lit(": highlighted "), counted(incident), F.lit(" connected reference(s). Click the node again or the background to clear."))


def view_model(report: DataFrame) -> DataFrame:
    """One row per report: graph views and counts, with '' / [] / 0 for what is missing."""
    got = {c.lower() for c in report.columns}

    def value(path: str, missing: Column) -> Column:
        return F.coalesce(F.col(path), missing) if path.split(".")[0] in got else missing

    def size(path: str) -> Column:
        return F.greatest(F.coalesce(F.size(F.col(path)), F.lit(0)), F.lit(0)) if path.split(".")[0] in got else F.lit(0)

    text, number = F.lit(""), F.lit(0)
    nodes = lambda path: F.col(path) if path.split(".")[0] in got else F.array().cast("array<string>")
    return report.select(
        value("solution_path", text).alias("solution_path"),
        value("solution_name", text).alias("solution_name"),
        value("project_count", number).cast("long").alias("project_count"),
        value("namespaces.namespace_count", number).cast("long").alias("namespace_count"),
        size("project_cycles").alias("project_cycle_count"),
        size("namespaces.cycles").alias("namespace_cycle_count"),
        F.struct(
            value("mermaid", text).alias("mermaid"),
            nodes("diagram_projects").alias("nodes"),
            nodes("diagram_edges").alias("edges"),
            nodes("project_cycles").alias("cycles"),
        ).alias("projects"),
        F.struct(
            value("namespaces.mermaid", text).alias("mermaid"),
            nodes("namespaces.diagram_nodes").alias("nodes"),
            nodes("namespaces.diagram_edges").alias("edges"),
            nodes("namespaces.cycles").alias("cycles"),
        ).alias("namespaces"),
        value("warnings", F.array().cast("array<string>")).alias("warnings"),
        value("notes", F.array().cast("array<string>")).alias("notes"),
    )
