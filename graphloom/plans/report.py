"""The whole analysis of a solution, as lazy tables and one report row."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph
from graphloom.operators import degrees as deg
from graphloom.operators import edges as edge_ops
from graphloom.operators import namespaces as ns_ops
from graphloom.operators.numbering import numbered
from graphloom.options import CLI_LIMITS, AnalyzeOptions, parse_arguments, positive_int
from graphloom.plans import contract, diagnostics
from graphloom.plans.mermaid import empty_text
from graphloom.plans.sink import Rows, gathered, write_report
from graphloom.sources import listing
from graphloom.sources.csharp import parse_sources
from graphloom.sources.project_xml import load_projects
from graphloom.sources.solution import classic_projects, xml_projects
from graphloom.staging import stage


class AnalysisError(ValueError):
    """An analysis that cannot start."""


def check_solution(path: str | None) -> str:
    """The absolute path; three different errors for a blank, missing or unsupported one."""
    if not path or not path.strip():
        raise AnalysisError("A solution path is required.")
    whole = path if "://" in path else os.path.abspath(path)
    if not listing.is_file(whole):
        raise FileNotFoundError(f"Solution file was not found: {whole}")
    if not whole.lower().endswith((".sln", ".slnx")):
        raise AnalysisError(f"Only .sln and .slnx are supported. Received: {whole}")
    return whole


@dataclass
class NamespaceResult:
    graph: DependencyGraph | None
    notes: list[str]
    namespace_count: int = 0
    dependency_count: int = 0
    mermaid: str = empty_text("No namespace data")
    cycles: DataFrame | None = None
    cycle_count: int = 0
    diagram_nodes: list[dict] = field(default_factory=list)
    diagram_edges: list[dict] = field(default_factory=list)

    def as_dict(self) -> dict:
        return {
            "namespaceCount": self.namespace_count, "dependencyCount": self.dependency_count, "mermaid": self.mermaid,
            "diagramNodes": self.diagram_nodes, "diagramEdges": self.diagram_edges, "cycles": _cycle_rows(self.cycles), "notes": self.notes,
        }


def _cycle_rows(cycles: DataFrame | None) -> Rows | list:
    fields = {"scope": F.col("scope"), "nodes": F.col("nodes"), "length": F.col("length")}
    return [] if cycles is None else Rows.of(cycles, [F.col("rank")], fields)


def _diagram(graph: DependencyGraph) -> tuple[str, list[dict], list[dict], DataFrame]:
    """Text, nodes and edges of a cut graph, bounded by the options, and the table of all cycles."""
    drawn, edges = (stage(x, "diagram") for x in graph.diagram)
    graph.diagram = (drawn, edges)
    nodes = [
        {"nodeId": r["node_id"], "lookupKey": str(r["key"]), "name": r["name"], "kind": r["kind"], "inCycle": r["in_cycle"], "representativeFile": r["representative_file"]}
        for r in drawn.orderBy("position").collect()
    ]
    links = [
        {
            "edgeId": r["edge_id"], "sourceKey": str(r["source_key"]), "targetKey": str(r["target_key"]), "sourceNodeId": r["source_node_id"],
            "targetNodeId": r["target_node_id"], "sourceName": r["source_name"], "targetName": r["target_name"], "count": r["count"], "inCycle": r["in_cycle"],
        }
        for r in edges.orderBy("position").collect()
    ]
    return graph.mermaid().first()["mermaid"], nodes, links, stage(graph.cycles(), "cycles")


def analyze_namespaces(projects: DataFrame, options: AnalyzeOptions) -> NamespaceResult:
    """The namespace graph of the C# projects among ``projects`` (key, name, full_path, kind), in the order of name and key."""
    spark = projects.sparkSession
    csharp = stage(numbered(projects.where(F.lower("full_path").endswith(".csproj")), [F.col("name"), F.col("key")], "project_order"), "csharp-projects")
    n_projects = csharp.count()
    if not n_projects:
        return NamespaceResult(None, [contract.NO_NAMESPACES])
    folder = F.regexp_extract("full_path", r"^(.+)/[^/]*$", 1)
    files = listing.listed_sources(csharp.select("project_order", F.col("name").alias("project"), F.when(folder == "", "/").otherwise(folder).alias("folder")))
    read = lambda batch: parse_sources(listing.with_content(batch.select("project_order", "project", "file", "scan_order"), "file"))
    parsed, cut = ns_ops.parsed_files(files, options.max_source_files, options.max_source_bytes, read)
    truncated = cut.first()["truncated"]
    parsed = parsed.drop("scan_order").withColumn("record", F.concat_ws("|", "project_order", "file"))
    n_files = parsed.count()
    order = F.struct("project_order", "file").alias("scan_order")
    declared = stage(parsed.select("record", "project", "file", order, F.explode("namespaces").alias("ns")), "source-declared")
    if declared.isEmpty():
        return NamespaceResult(None, [contract.NO_DECLARATIONS % n_files])
    usings = parsed.where(F.size("namespaces") > 0).select("record", F.explode("usings").alias("target"))
    shared = parsed.select("project", F.explode("global_usings").alias("target")).distinct()
    kinds = csharp.select(F.col("name").alias("project"), "kind", F.col("project_order").alias("ord"))
    nodes = stage(ns_ops.namespace_nodes(declared, kinds), "namespace-nodes")
    edges = stage(ns_ops.namespace_edges(declared, usings, shared), "namespace-edges")
    graph = DependencyGraph.from_edges(nodes, edges, "namespace", options)
    mermaid, drawn, links, cycles = _diagram(graph)
    n_nodes, n_edges = nodes.count(), edges.count()
    numbers = {
        "projects": n_projects, "files": n_files, "namespaces": n_nodes, "dependencies": n_edges, "drawn": len(drawn), "shown": len(links),
        "truncated": truncated, "cap": options.max_source_files,
    }
    notes = list(spark.createDataFrame([tuple(numbers.values())], list(numbers)).select(contract.namespace_notes().alias("n")).first()["n"])
    return NamespaceResult(graph, notes, n_nodes, n_edges, mermaid, cycles, cycles.count(), drawn, links)


@dataclass
class DependencyReport:
    """Everything found out about one solution; ``graph(granularity)`` has the tables, ``write`` makes the file.

    ``parts`` is the report with its long arrays as tables; ``content`` and
    ``to_json`` bring all of it to the driver.
    """

    spark: SparkSession
    solution_path: str
    projects: DependencyGraph | None
    namespaces: NamespaceResult
    parts: dict
    table: DataFrame | None = None
    cycles: DataFrame | None = None

    @cached_property
    def content(self) -> dict:
        return gathered(self.parts)

    def graph(self, granularity: str) -> DependencyGraph:
        found = self.projects if granularity == "projects" else self.namespaces.graph
        if found is None:
            raise AnalysisError(f"There is no {granularity} graph.")
        return found

    def to_json(self) -> str:
        return json.dumps(self.content, indent=2, ensure_ascii=False)

    def write(self, path: str) -> None:
        write_report(self.parts, path if "://" in path else os.path.abspath(path), self.spark)

    def diagnostics(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """``(file, messages)`` and the unanchored messages of all cycles."""
        none = spark.createDataFrame([], "rank int, nodes array<string>")
        if self.table is None:
            listed = spark.createDataFrame([], "name string, relative_path string, ord string")
        else:
            listed = self.table.select("name", "relative_path", F.col("key").alias("ord"))
        drawn = [(n["name"], n["representativeFile"], i) for i, n in enumerate(self.namespaces.diagram_nodes)]
        shown = spark.createDataFrame(drawn, "name string, representative_file string, ord int")
        a = diagnostics.project_diagnostics(none if self.cycles is None else self.cycles, listed, os.path.dirname(self.solution_path))
        b, loose = diagnostics.namespace_diagnostics(none if self.namespaces.cycles is None else self.namespaces.cycles, shown)
        return diagnostics.by_file(a.unionByName(b)), loose


def _empty(spark: SparkSession, path: str, note: str, warnings: Rows | list[str], what: str, namespace_note: str) -> DependencyReport:
    none = NamespaceResult(None, [namespace_note])
    return DependencyReport(spark, path, None, none, _content(path, {}, [], [], [], [note], warnings, empty_text(what), [], [], [], none))


def _content(path, counts, kinds, hubs, projects, notes, warnings, mermaid, nodes, edges, cycles, namespaces) -> dict:
    return {
        "solutionPath": path,
        "solutionName": os.path.splitext(os.path.basename(path))[0],
        "projectCount": counts.get("project_count", 0),
        "totalDependencies": counts.get("total_dependencies", 0),
        "totalPackageReferences": counts.get("total_package_references", 0),
        "testProjectCount": counts.get("test_project_count", 0),
        "projectKinds": kinds, "dependencyHubs": hubs, "notes": notes, "warnings": warnings, "mermaid": mermaid,
        "projects": projects, "diagramProjects": nodes, "diagramEdges": edges, "projectCycles": cycles, "namespaces": namespaces.as_dict(),
    }


def analyze(spark: SparkSession, solution_path: str, options: AnalyzeOptions | None = None) -> DependencyReport:
    """Read a solution, its projects and sources, and report on both graphs.

    The driver holds what the options bound: diagrams, hubs and kinds. Lists
    of projects, warnings and cycles stay tables.
    """
    options = options or AnalyzeOptions()
    path = check_solution(solution_path)
    files = listing.with_content(spark.createDataFrame([(path,)], "path string"), "path")
    xml = path.lower().endswith(".slnx")
    notes = [contract.XML_SOLUTION] if xml else []
    found = stage(xml_projects(files) if xml else classic_projects(files), "solution-projects").drop("path")
    if found.isEmpty():
        return _empty(
            spark, path, contract.NO_PROJECT_FILES, [], "No projects found",
            contract.NO_PROJECTS,
        )
    loaded = stage(load_projects(listing.with_content(found, "full_path"), options.path_mode), "projects-loaded")
    # Of entries with one path the first by name and id counts.
    said = F.format_string(contract.FAILED, "name", "error")
    failed = loaded.where("error IS NOT NULL").select(F.lit(0).alias("kind"), F.col("name").alias("a"), F.col("id").alias("b"), said.alias("text"))
    listed_warnings = lambda df: Rows.of(df, [F.col("kind"), F.col("a"), F.col("b")], F.col("text"))
    good = loaded.where("error IS NULL")
    once = good.groupBy("key").agg(F.min_by(F.struct(*[c for c in good.columns if c != "key"]), F.struct("name", "id")).alias("p")).select("key", "p.*")
    once = stage(once, "projects-once")
    if once.isEmpty():
        return _empty(
            spark, path, contract.NONE_PARSED_FILES, listed_warnings(failed), "No projects could be parsed",
            contract.NONE_PARSED,
        )
    again = F.format_string(contract.REPEATED, "key", "n")
    repeated = good.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(1).alias("kind"), F.col("key").alias("a"), F.lit("").alias("b"), again.alias("text"))
    warnings: list[str] = []
    nodes = once.select("key", "name", "kind", "group_path", F.size("packages").alias("package_references"), F.lit(None).cast("string").alias("representative_file"))
    references = once.select(F.col("key").alias("source_key"), F.explode("refs").alias("r")).select("source_key", "r.target_key", "r.is_conditional")
    edges = stage(edge_ops.weighted_edges(references, nodes), "project-edges")
    graph = DependencyGraph.from_edges(nodes, edges, "project", options)
    counts = graph.totals().first().asDict()
    outside = edge_ops.reference_counts(references, nodes).first()
    mermaid, drawn, links, cycles = _diagram(graph)
    n, m = counts["project_count"], counts["edge_count"]
    if len(drawn) < n:
        notes.append(contract.SHOWN_PROJECTS % (len(drawn), n))
    if len(links) < m:
        notes.append(contract.SHOWN_EDGES % (len(links), m))
    packages = counts["total_package_references"]
    if packages:
        notes.append(contract.PACKAGES % (packages, n))
    if outside["external_references"]:
        warnings.append(contract.OUTSIDE % outside["external_references"])
    if outside["conditional_references"]:
        warnings.append(contract.CONDITIONAL % outside["conditional_references"])
    if n_cycles := cycles.count():
        involved = graph.cycle_nodes.count()
        warnings.append(contract.CIRCULAR % (n_cycles, involved))
    table = stage(deg.node_degrees(once.withColumn("package_references", F.size("packages")), edges), "project-table")
    namespaces = analyze_namespaces(table, options)
    if namespaces.cycle_count:
        warnings.append(contract.CIRCULAR_NAMESPACES % (namespaces.cycle_count, namespaces.namespace_count))
    fixed = spark.createDataFrame([(2, f"{i:02}", "", w) for i, w in enumerate(warnings)], "kind int, a string, b string, text string")
    c = F.col
    content = _content(
        path, counts,
        [{"name": r["kind"], "count": r["count"]} for r in graph.kinds().collect()],
        [
            {"name": r["name"], "kind": r["kind"], "outgoingDependencies": r["outgoing"], "incomingDependencies": r["incoming"], "packageReferences": r["package_references"]}
            for r in graph.hubs().collect()
        ],
        Rows.of(table, [c("name"), c("key")], {
            "name": c("name"), "relativePath": c("relative_path"), "groupPath": c("group_path"), "kind": c("kind"), "targetFramework": c("target_framework"),
            "outgoingDependencies": c("outgoing"), "incomingDependencies": c("incoming"), "packageReferences": c("package_references"),
        }),
        notes, listed_warnings(failed.unionByName(repeated).unionByName(fixed)), mermaid, drawn, links, _cycle_rows(cycles), namespaces,
    )
    return DependencyReport(spark, path, graph, namespaces, content, table, cycles)


def main(args: list[str], spark: SparkSession | None = None) -> None:
    """``--solution FILE --output FILE [--max-projects N] [--max-edges N]``."""
    got = parse_arguments(args)
    for needed in ("solution", "output"):
        if not got.get(needed, "").strip():
            raise AnalysisError(f"Missing required option --{needed}")
    options = AnalyzeOptions(positive_int(got.get("max-projects"), CLI_LIMITS[0]), positive_int(got.get("max-edges"), CLI_LIMITS[1]))
    session = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    analyze(session, got["solution"], options).write(got["output"])


