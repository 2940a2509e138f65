"""A dependency graph: nodes, weighted edges, and what is asked of them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import degrees as deg
from graphloom.operators import edges as edge_ops
from graphloom.operators import scc, topk
from graphloom.options import AnalyzeOptions
from graphloom.plans import mermaid, view
from graphloom.staging import stage


class DependencyGraph:
    """``nodes`` (key, name, kind, group_path, package_references, representative_file), ``edges`` (source_key, target_key, count).

    Degrees, components and cycles are those of the whole graph; only the
    diagram is cut to the options' limits.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, scope: str = "project", options: AnalyzeOptions | None = None):
        self.nodes, self.scope, self.options = nodes, scope, options or AnalyzeOptions()
        self.edges = edges

    @classmethod
    def from_edges(cls, nodes: DataFrame, edges: DataFrame, scope: str = "project", options: AnalyzeOptions | None = None) -> DependencyGraph:
        """Fills in the columns that ``nodes`` lacks."""
        missing = {"kind": F.lit("library"), "group_path": F.lit(""), "package_references": F.lit(0), "representative_file": F.lit(None).cast("string")}
        for name, value in missing.items():
            if name not in nodes.columns:
                nodes = nodes.withColumn(name, value)
        return cls(nodes.select(*edge_ops.NODE_COLUMNS), edges, scope, options)

    @cached_property
    def named_edges(self) -> DataFrame:
        return edge_ops.named_edges(self.edges, self.nodes)

    def degrees(self) -> DataFrame:
        return deg.node_degrees(self.nodes, self.edges)

    def hubs(self, n: int = 6) -> DataFrame:
        return deg.hubs(self.nodes, self.edges, n)

    def kinds(self) -> DataFrame:
        return deg.kind_summary(self.nodes)

    def totals(self) -> DataFrame:
        return deg.totals(self.nodes, self.edges)

    @cached_property
    def components(self) -> DataFrame:
        return stage(scc.components(self.nodes, self.edges), "graph-scc")

    @cached_property
    def cycle_nodes(self) -> DataFrame:
        return scc.cycle_nodes(self.components, self.edges)

    @cached_property
    def cycle_edges(self) -> DataFrame:
        return scc.cycle_edges(self.cycle_nodes, self.edges)

    def cycles(self) -> DataFrame:
        return scc.cycles(self.cycle_nodes, self.nodes, self.scope)

    def cycle_members(self, size: int = scc.CHUNK_MEMBERS) -> DataFrame:
        """Members of cycles of any size, a row for each."""
        return scc.cycle_members(self.cycle_nodes, self.nodes, size)

    def top(self, n: int | None = None, m: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The most linked nodes and the heaviest edges between them."""
        nodes = topk.top_nodes(self.nodes, self.edges, n or self.options.nodes)
        return nodes, topk.top_edges(self.named_edges, nodes, m or self.options.edges)

    @cached_property
    def diagram(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = self.top()
        # At most ``max_nodes`` and ``max_edges`` rows, which every part of the text reads.
        drawn = stage(mermaid.diagram_nodes(nodes, self.cycle_nodes), "diagram-nodes")
        return drawn, stage(mermaid.diagram_edges(edges, drawn, self.cycle_edges), "diagram-edges")

    def mermaid_lines(self) -> DataFrame:
        return mermaid.mermaid_lines(*self.diagram)

    def mermaid(self) -> DataFrame:
        return mermaid.mermaid_text(self.mermaid_lines())

    def neighbourhood(self, key) -> tuple[DataFrame, DataFrame]:
        return view.neighbourhood_nodes(self.nodes, self.edges, key), view.neighbourhood_edges(self.edges, key)

    def highlight_cycle(self, names: list[str]) -> DataFrame:
        return view.cycle_highlight(self.named_edges, names)
