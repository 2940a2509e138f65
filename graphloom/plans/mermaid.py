"""Diagram tables and flowchart text of a cut graph.

The windows over all rows here run on what the cut has left (at most
max_nodes nodes and max_edges edges).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.expressions import escape_label, group_or_root
from graphloom.operators.edges import edge_order

CYCLE_STYLE = "stroke:#e5484d,stroke-width:2px"


def empty_text(what: str) -> str:
    return f'flowchart LR\n  Empty["{what}"]'


def diagram_nodes(nodes: DataFrame, cyclic: DataFrame) -> DataFrame:
    """``nodes`` with their number in the diagram, node id, group number and whether they are in a cycle."""
    marked = nodes.join(cyclic.select("key", F.lit(True).alias("in_cycle")).distinct(), "key", "left")
    marked = marked.withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False))).withColumn("group_name", group_or_root(F.col("group_path")))
    # Upper case, so that an underscore comes after letters.
    folded = F.upper("group_name")
    place = Window.orderBy(folded, "name", "key")
    return marked.select(
        (F.row_number().over(place) - 1).alias("position"),
        (F.dense_rank().over(Window.orderBy(folded)) - 1).alias("group_position"),
        folded.alias("group_key"),
        "*",
    ).withColumn("node_id", F.concat(F.lit("P"), F.col("position").cast("string")))


def diagram_edges(named: DataFrame, drawn: DataFrame, cyclic_edges: DataFrame) -> DataFrame:
    """Named edges between drawn nodes with their number, ids and whether they are in a cycle."""
    ids = drawn.select("key", "node_id")
    ended = named.join(ids.toDF("source_key", "source_node_id"), "source_key").join(ids.toDF("target_key", "target_node_id"), "target_key")
    mark = cyclic_edges.select("source_key", "target_key", F.lit(True).alias("in_cycle")).distinct()
    ended = ended.join(mark, ["source_key", "target_key"], "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    numbered = ended.select((F.row_number().over(Window.orderBy(*edge_order())) - 1).alias("position"), "*")
    return numbered.withColumn("edge_id", F.concat(F.lit("E"), F.col("position").cast("string")))


def mermaid_lines(drawn: DataFrame, edges: DataFrame) -> DataFrame:
    """``(section, a, b, line)`` in the order of the flowchart text."""
    spark = drawn.sparkSession
    number = lambda c: F.col(c).cast("int")

    def part(df: DataFrame, section: int, a, b, line) -> DataFrame:
        return df.select(F.lit(section).alias("section"), a.cast("int").alias("a"), b.cast("int").alias("b"), line.alias("line"))

    zero, last = F.lit(0), F.lit(1 << 30)
    head = part(spark.range(1), 0, zero, zero, F.lit("flowchart LR"))
    # The first member by name gives the group's spelling.
    groups = drawn.groupBy("group_position").agg(F.min_by("group_name", "position").alias("g"))
    opened = F.concat(F.lit("  subgraph G"), F.col("group_position").cast("string"), F.lit('["'), escape_label(F.col("g")), F.lit('"]'))
    node = F.concat(F.lit("    "), F.col("node_id"), F.lit('["'), escape_label(F.col("name")), F.lit("\\n"), escape_label(F.col("kind")), F.lit('"]'))
    arrow = F.concat(F.lit("  "), F.col("source_node_id"), F.lit(" "), F.col("edge_id"), F.lit("@--> "), F.col("target_node_id"))
    some_nodes = drawn.agg(F.count(F.lit(1)).alias("n"))
    no_nodes = part(some_nodes.where("n = 0"), 1, zero, zero, F.lit('  Empty["No nodes found"]'))
    edge_count = edges.agg(F.count(F.lit(1)).alias("m"))
    no_edges = part(some_nodes.join(edge_count, F.lit(True)).where("n > 0 AND m = 0"), 2, zero, zero, F.lit('  EmptyLink["No dependencies found"]'))
    styles = part(drawn.where("in_cycle"), 4, number("position"), zero, F.concat(F.lit("  style "), F.col("node_id"), F.lit(f" {CYCLE_STYLE}")))
    linked = edges.where("in_cycle").agg(F.array_join(F.transform(F.array_sort(F.collect_list("position")), lambda x: x.cast("string")), ",").alias("e"))
    links = part(linked.where("e <> ''"), 5, zero, zero, F.concat(F.lit("  linkStyle "), F.col("e"), F.lit(f" {CYCLE_STYLE}")))
    parts = [
        head, no_nodes,
        part(groups, 1, number("group_position"), F.lit(-1), opened),
        part(drawn, 1, number("group_position"), number("position"), node),
        part(groups, 1, number("group_position"), last, F.lit("  end")),
        no_edges, part(edges, 3, number("position"), zero, arrow), styles, links,
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def mermaid_text(lines: DataFrame) -> DataFrame:
    """One row: the lines joined by line feeds."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "a", "b", "line")))
    return lines.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("mermaid"))
