"""The report as one row in the shape that its readers expect, made from tables, and the reader of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from graphloom.model import DependencyGraph
from graphloom.operators import degrees as deg
from graphloom.plans.mermaid import empty_text
from graphloom.sources.long_json import RANGE, array_elements

#: Fixed values of the report: field names and sentences.
_CYCLES = "array<struct<scope:string,nodes:array<string>,length:bigint>>"
_NODES = "array<struct<nodeId:string,lookupKey:string,name:string,kind:string,inCycle:boolean,representativeFile:string>>"
_EDGES = (
    "array<struct<edgeId:string,sourceKey:string,targetKey:string,sourceNodeId:string,targetNodeId:string,sourceName:string,"
    "targetName:string,count:bigint,inCycle:boolean>>"
)
REPORT_SCHEMA = (
    "solutionPath string, solutionName string, projectCount bigint, totalDependencies bigint, totalPackageReferences bigint, testProjectCount bigint, "
    "projectKinds array<struct<name:string,count:bigint>>, "
    "dependencyHubs array<struct<name:string,kind:string,outgoingDependencies:bigint,incomingDependencies:bigint,packageReferences:bigint>>, "
    "notes array<string>, warnings array<string>, mermaid string, "
    "projects array<struct<name:string,relativePath:string,groupPath:string,kind:string,targetFramework:string,outgoingDependencies:bigint,"
    "incomingDependencies:bigint,packageReferences:bigint>>, "
    f"diagramProjects {_NODES}, diagramEdges {_EDGES}, projectCycles {_CYCLES}, "
    f"namespaces struct<namespaceCount:bigint,dependencyCount:bigint,mermaid:string,diagramNodes:{_NODES},diagramEdges:{_EDGES},cycles:{_CYCLES},notes:array<string>>"
)
SHOWN_PROJECTS = "Diagram truncated to the top %d projects out of %d total."
SHOWN_EDGES = "Showing the top %d project reference edges out of %d total."
PACKAGES = "PackageReference nodes are summarized only: %d package reference(s) across %d project(s)."
OUTSIDE = "%d project reference(s) point outside the selected solution and are summarized as externals."
CONDITIONAL = "%d conditional ProjectReference item(s) were detected and may vary by configuration."
CIRCULAR = "%d circular project-dependency group(s) detected involving %d project(s)."
CIRCULAR_NAMESPACES = "%d circular namespace-dependency group(s) detected across %d namespace(s)."
FAILED = "Failed to parse project '%s': %s"
REPEATED = "Project path '%s' is listed %d times; the first entry is used."
XML_SOLUTION = "The selected .slnx file was parsed through XML project discovery."
NO_PROJECT_FILES = "No supported project files were found in the selected solution."
NO_PROJECTS = "No projects were found, so namespace analysis was skipped."
NONE_PARSED_FILES = "No project files could be parsed from the selected solution."
NONE_PARSED = "No projects could be parsed, so namespace analysis was skipped."
NO_NAMESPACES = "Namespace analysis runs on C# projects only; no .csproj files were found."
NO_DECLARATIONS = "Parsed %d C# file(s), but found no namespace declarations (top-level statements are skipped)."
NAMESPACE_EDGES = "Namespace edges are derived from `using` directives among %d solution namespace(s) (C# syntax only)."
NAMESPACE_FILES = "Parsed %d C# source file(s) across %d C# project(s)."
SCAN_STOPPED = "Source scan stopped after %d files; namespace data may be incomplete."
SHOWN_NAMESPACES = "Namespace diagram truncated to the top %d of %d namespaces."
SHOWN_NAMESPACE_EDGES = "Showing the top %d of %d namespace dependency edges."


def _listed(df: DataFrame, order: list[Column], fields: dict[str, Column], name: str) -> DataFrame:
    """One row: all rows of ``df`` as structs in ``order``. What is listed is what a person reads."""
    keys = [o.alias(f"o{i}") for i, o in enumerate(order)]
    row = F.struct(*keys, F.struct(*[v.alias(k) for k, v in fields.items()]).alias("v"))
    return df.agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"]).alias(name))


def diagram_lists(graph: DependencyGraph, nodes: str, edges: str, cycles: str) -> list[DataFrame]:
    """One row each: the diagram's nodes and edges, and the cycles."""
    drawn, shown = graph.diagram
    c = F.col
    return [
        _listed(drawn, [c("position")], {
            "nodeId": c("node_id"), "lookupKey": c("key").cast("string"), "name": c("name"), "kind": c("kind"), "inCycle": c("in_cycle"),
            "representativeFile": c("representative_file"),
        }, nodes),
        _listed(shown, [c("position")], {
            "edgeId": c("edge_id"), "sourceKey": c("source_key").cast("string"), "targetKey": c("target_key").cast("string"), "sourceNodeId": c("source_node_id"),
            "targetNodeId": c("target_node_id"), "sourceName": c("source_name"), "targetName": c("target_name"), "count": c("count"), "inCycle": c("in_cycle"),
        }, edges),
        _listed(graph.cycles(), [c("rank")], {"scope": c("scope"), "nodes": c("nodes"), "length": c("length").cast("long")}, cycles),
    ]


def report_row(graph: DependencyGraph, projects: DataFrame, outside: DataFrame, path: str) -> DataFrame:
    """One row in the report's shape for a project graph without namespaces.

    ``projects`` (key, relative_path, target_framework) adds to the graph's
    nodes; ``outside`` is the row of ``reference_counts``.
    """
    c = F.col
    table = graph.degrees().join(projects, "key")
    linked = c("outgoing") + c("incoming")
    degrees = {"outgoingDependencies": c("outgoing"), "incomingDependencies": c("incoming"), "packageReferences": c("package_references").cast("long")}
    parts = [
        *diagram_lists(graph, "diagramProjects", "diagramEdges", "projectCycles"),
        outside, graph.mermaid(), graph.cycle_nodes.agg(F.count(F.lit(1)).alias("involved")),
        _listed(graph.kinds(), [-c("count"), c("kind")], {"name": c("kind"), "count": c("count")}, "projectKinds"),
        _listed(graph.hubs(), [-linked, -c("package_references"), c("name"), c("key")], {"name": c("name"), "kind": c("kind"), **degrees}, "dependencyHubs"),
        _listed(table, [c("name"), c("key")], {
            "name": c("name"), "relativePath": c("relative_path"), "groupPath": c("group_path"), "kind": c("kind"), "targetFramework": c("target_framework"), **degrees,
        }, "projects"),
    ]
    whole = deg.totals(graph.nodes, graph.edges)
    for part in parts:
        # One row each.
        whole = whole.join(part, F.lit(True))
    drawn, shown, n, m, packages = F.size("diagramProjects"), F.size("diagramEdges"), c("project_count"), c("edge_count"), c("total_package_references")
    said = lambda test, text, *values: F.when(test, F.format_string(text, *values))
    notes = F.array_compact(F.array(
        said(drawn < n, SHOWN_PROJECTS, drawn, n), said(shown < m, SHOWN_EDGES, shown, m), said(packages > 0, PACKAGES, packages, n),
    ))
    warnings = F.array_compact(F.array(
        said(c("external_references") > 0, OUTSIDE, c("external_references")), said(c("conditional_references") > 0, CONDITIONAL, c("conditional_references")),
        said(F.size("projectCycles") > 0, CIRCULAR, F.size("projectCycles"), c("involved")),
    ))
    none = lambda kind: F.array().cast(kind)
    namespaces = F.struct(
        F.lit(0).cast("long").alias("namespaceCount"), F.lit(0).cast("long").alias("dependencyCount"), F.lit(empty_text("No namespace data")).alias("mermaid"),
        none(_NODES).alias("diagramNodes"), none(_EDGES).alias("diagramEdges"), none(_CYCLES).alias("cycles"), F.array(F.lit(NO_NAMESPACES)).alias("notes"),
    )
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return whole.select(
        F.lit(path).alias("solutionPath"), F.lit(name).alias("solutionName"), n.alias("projectCount"), c("total_dependencies").alias("totalDependencies"),
        packages.alias("totalPackageReferences"), c("test_project_count").alias("testProjectCount"), "projectKinds", "dependencyHubs", notes.alias("notes"),
        warnings.alias("warnings"), "mermaid", "projects", "diagramProjects", "diagramEdges", "projectCycles", namespaces.alias("namespaces"),
    )


def namespace_notes() -> Column:
    """The notes of a namespace graph, in order, from a row of its numbers.

    The row has projects, files, namespaces, dependencies, drawn and shown
    (nodes and edges of the diagram), truncated and cap (of the scan).
    """
    c = F.col
    said = lambda test, text, *values: F.when(test, F.format_string(text, *values))
    found = F.array_compact(F.array(
        F.format_string(NAMESPACE_EDGES, "namespaces"), F.format_string(NAMESPACE_FILES, "files", "projects"), said(c("truncated"), SCAN_STOPPED, c("cap")),
        said(c("drawn") < c("namespaces"), SHOWN_NAMESPACES, c("drawn"), c("namespaces")),
        said(c("shown") < c("dependencies"), SHOWN_NAMESPACE_EDGES, c("shown"), c("dependencies")),
    ))
    only = lambda text, *values: F.array(F.format_string(text, *values)) if values else F.array(F.lit(text))
    return F.when(c("projects") == 0, only(NO_NAMESPACES)).when(c("namespaces") == 0, only(NO_DECLARATIONS, c("files"))).otherwise(found)


def report_text(row: DataFrame) -> DataFrame:
    """``(report)``: the row as indented JSON, nulls included."""
    return row.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("report"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """One row for each report file at ``path``; fields that a file lacks are null, others are passed over.

    A task reads a file and a row holds it; ``read_elements`` reads long ones.
    """
    return spark.read.json(path, schema=REPORT_SCHEMA, multiLine=True)


def read_elements(spark: SparkSession, path: str, width: int = RANGE) -> DataFrame:
    """``(listed, position, v)``: every element of the arrays that a report file's object has, in one row each, by ``width`` bytes a task.

    ``v`` has a field for each array, of which only the one named by ``listed`` is filled.
    The namespaces' arrays lie deeper and are read by ``read_report``.
    """
    whole = StructType.fromDDL(REPORT_SCHEMA)
    kinds = {f.name: f.dataType.elementType for f in whole if isinstance(f.dataType, ArrayType)}
    schema = ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds.items())
    found = array_elements(spark, path, width).where(F.col("listed").isin(*kinds))
    text = F.concat(F.lit('{"'), "listed", F.lit('":'), "value", F.lit("}"))
    return found.select("listed", "position", F.from_json(text, schema).alias("v"))
