"""The registered queries of the graph engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import expressions as ex
from graphloom.model import DependencyGraph
from graphloom.operators import degrees as deg
from graphloom.operators import edges as edge_ops
from graphloom.operators import namespaces as ns_ops
from graphloom.operators import scc, topk
from graphloom.options import AnalyzeOptions
from graphloom.plans import bindings as b
from graphloom.plans import contract, diagnostics, view
from graphloom.plans.sink import Rows, write_report
from graphloom.sources import csharp, listing, project_xml, solution
from graphloom.staging import delete_at_exit, shared_dir, stage

CUT = AnalyzeOptions(max_nodes=8, max_edges=15)
USERS = AnalyzeOptions(max_nodes=20, max_edges=30)
NAMESPACES = AnalyzeOptions(max_nodes=12, max_edges=20)


def nation_graph(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    nodes = stage(b.nation_nodes(spark, sf_dir), "nation-nodes")
    edges = stage(edge_ops.weighted_edges(b.nation_references(spark, sf_dir), nodes), "nation-edges")
    return DependencyGraph.from_edges(nodes, edges, "project", CUT)


def user_graph(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    edges = stage(b.top_successors(b.succession_edges(spark, sf_dir)), "user-edges")
    return DependencyGraph.from_edges(b.user_nodes(edges), edges, "project", USERS)


def project_edges(spark, sf_dir):
    g = nation_graph(spark, sf_dir)
    return g.named_edges


def external_conditional_counts(spark, sf_dir):
    return edge_ops.reference_counts(b.nation_references(spark, sf_dir), b.nation_nodes(spark, sf_dir))


def node_degrees(spark, sf_dir):
    return nation_graph(spark, sf_dir).degrees().select("key", "name", "kind", "group_path", "package_references", "outgoing", "incoming")


def dependency_hubs_top6(spark, sf_dir):
    return nation_graph(spark, sf_dir).hubs(6).select("key", "name", "kind", "package_references", "outgoing", "incoming")


def kind_summary(spark, sf_dir):
    return deg.kind_summary(b.nation_nodes(spark, sf_dir))


def report_totals(spark, sf_dir):
    return nation_graph(spark, sf_dir).totals()


def top_nodes(spark, sf_dir):
    return nation_graph(spark, sf_dir).top()[0].select("key", "name", "outgoing", "incoming", "package_references")


def visible_edges(spark, sf_dir):
    return nation_graph(spark, sf_dir).top()[1]


def packages_distinct_ci(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    value = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).when(F.col("p_partkey") % 7 == 0, F.lit("  ")).otherwise(F.lower("p_brand"))
    listed = part.select("p_size", "p_partkey", value.alias("v"))
    return project_xml.distinct_packages(listed, "p_size", "v", "p_partkey")


def target_framework_pick(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    single = F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).when(F.col("p_partkey") % 4 == 1, "")
    several = F.when(F.col("p_partkey") % 8 != 2, F.concat(F.lit(" ;"), F.replace("p_name", F.lit(" "), F.lit(" ; "))))
    return part.select("p_partkey", ex.target_framework(single, several).alias("framework"))


def group_path_recursive(spark, sf_dir):
    """Nations in regions in hemispheres in a root that, wrongly, lists itself below a hemisphere."""
    nation, region = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "region")
    n, r, h = (F.format_string(f"{x}%d", c) for x, c in (("n", "n_nationkey"), ("r", "n_regionkey"), ("r", "r_regionkey")))
    half = F.format_string("h%d", (F.col("r_regionkey") % 2).cast("int"))
    ends = spark.createDataFrame([("h0", "root"), ("h1", "root"), ("root", "h1")], "child string, parent string")
    parents = nation.select(n.alias("child"), r.alias("parent")).unionByName(region.select(h.alias("child"), half.alias("parent"))).unionByName(ends)
    fixed = spark.createDataFrame([("h0", "even"), ("h1", "odd"), ("root", "world")], "key string, name string")
    names = region.select(h.alias("key"), F.col("r_name").alias("name")).unionByName(fixed)
    return solution.group_paths(nation.select(n.alias("child")), parents, names)


def scc_components(spark, sf_dir):
    return user_graph(spark, sf_dir).components


def scc_distributed(spark, sf_dir):
    """The same components from the reversed edges: a component has no direction."""
    g = user_graph(spark, sf_dir)
    back = g.edges.select(F.col("target_key").alias("source_key"), F.col("source_key").alias("target_key"))
    return scc.components(g.nodes, back)


def cycle_nodes(spark, sf_dir):
    return user_graph(spark, sf_dir).cycle_nodes


def cycle_edges(spark, sf_dir):
    return user_graph(spark, sf_dir).cycle_edges


def cycles(spark, sf_dir):
    return user_graph(spark, sf_dir).cycles().select("rank", "scope", F.array_join("nodes", ",").alias("nodes"), "length", "scc_id")


def _order_edges(spark, sf_dir):
    return ns_ops.namespace_edges(b.order_declarations(spark, sf_dir), b.order_usings(spark, sf_dir), b.order_global_usings(spark, sf_dir))


def namespace_edges(spark, sf_dir):
    return _order_edges(spark, sf_dir)


def _order_nodes(spark, sf_dir):
    return ns_ops.namespace_nodes(b.order_declarations(spark, sf_dir), b.segment_kinds(spark))


def namespace_group_kind(spark, sf_dir):
    return _order_nodes(spark, sf_dir).select("key", "group_path", "kind")


def representative_file(spark, sf_dir):
    return ns_ops.representative_files(b.order_declarations(spark, sf_dir))


def namespace_top_nodes(spark, sf_dir):
    return topk.top_nodes(_order_nodes(spark, sf_dir), _order_edges(spark, sf_dir), 10).select("key", "outgoing", "incoming")


def namespace_dependency_count(spark, sf_dir):
    return _order_edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("dependency_count"), F.coalesce(F.sum("count"), F.lit(0)).alias("weight"))


def diagram_nodes(spark, sf_dir):
    return user_graph(spark, sf_dir).diagram[0].select("node_id", "key", "name", "kind", "group_name", "group_position", "in_cycle", "representative_file")


def diagram_edges(spark, sf_dir):
    return user_graph(spark, sf_dir).diagram[1].select(
        "edge_id", "source_key", "target_key", "source_node_id", "target_node_id", "source_name", "target_name", "count", "in_cycle"
    )


def mermaid_lines(spark, sf_dir):
    return user_graph(spark, sf_dir).mermaid_lines()


def mermaid_text(spark, sf_dir):
    return user_graph(spark, sf_dir).mermaid()


def escape_labels(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    odd = F.concat(F.lit('<"'), "p_name", F.lit("\\"), F.lit("#>"), "p_brand")
    return part.select("p_partkey", ex.escape_label(odd).alias("label"))


def neighbourhood(spark, sf_dir):
    g = DependencyGraph.from_edges(*_users(spark, sf_dir))
    nodes, _ = g.neighbourhood(3)
    return nodes.join(view.incident_edge_counts(g.edges), "key", "left").select(
        "key", "is_selected", "is_related", "is_dimmed", F.coalesce("incident_edges", F.lit(0)).alias("incident_edges")
    )


def _users(spark, sf_dir):
    edges = stage(b.succession_edges(spark, sf_dir), "succession")
    return b.user_nodes(edges), edges


def neighbourhood_edges(spark, sf_dir):
    _, edges = _users(spark, sf_dir)
    return view.neighbourhood_edges(edges, 3)


def cycle_highlight(spark, sf_dir):
    nodes, edges = _users(spark, sf_dir)
    return DependencyGraph.from_edges(nodes, edges).highlight_cycle(["user-3", "user-5", "user-8", "user-13"])


def cycle_members(spark, sf_dir):
    """Members of all cycles in chunks of four."""
    return user_graph(spark, sf_dir).cycle_members(4)


def cycle_list(spark, sf_dir):
    return view.cycle_list(user_graph(spark, sf_dir).cycles())


def _diagnosed(spark, sf_dir):
    g = user_graph(spark, sf_dir)
    found = g.cycles()
    listed = g.nodes.where("key % 4 <> 1").select("name", F.concat(F.when(F.col("key") % 3 == 0, F.lit("/abs/")).otherwise(""), F.lit("p/../"), "name").alias("relative_path"), F.col("key").alias("ord"))
    drawn = g.nodes.where("key % 5 <> 2").select("name", "representative_file", F.col("key").alias("ord"))
    return found, listed, drawn


def cycle_diagnostics_anchored(spark, sf_dir):
    found, listed, drawn = _diagnosed(spark, sf_dir)
    a = diagnostics.project_diagnostics(found, listed, "/work/solution")
    c, _ = diagnostics.namespace_diagnostics(found, drawn)
    return diagnostics.by_file(a.unionByName(c)).select("file", F.array_join("messages", "|").alias("messages"))


def cycle_diagnostics_unanchored(spark, sf_dir):
    found, _, drawn = _diagnosed(spark, sf_dir)
    return diagnostics.namespace_diagnostics(found, drawn)[1]


def _graph_counts(spark, sf_dir):
    g = user_graph(spark, sf_dir)
    nodes, edges = g.diagram
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    return n.join(edges.agg(F.count(F.lit(1)).alias("edges")), F.lit(True)).join(g.cycles().agg(F.count(F.lit(1)).alias("cycles")), F.lit(True))


def status_messages(spark, sf_dir):
    n, m, c = F.col("nodes"), F.col("edges"), F.col("cycles")
    return _graph_counts(spark, sf_dir).select(
        view.status_text(n, m, c, "project").alias("status"), view.summary_text(n, m, c).alias("summary"),
        view.selection_text(F.lit("user-3"), n * 1000).alias("selected"), ex.export_file_name(F.lit("My (1) app"), "project", "svg").alias("file_name"),
    )


def view_model_meta(spark, sf_dir):
    g = user_graph(spark, sf_dir)
    listed = g.cycles().agg(F.collect_list(F.struct("scope", "nodes", "length")).alias("project_cycles"))
    report = g.totals().join(listed, F.lit(True)).select(F.lit("/a/b.sln").alias("solution_path"), "project_count", "project_cycles")
    meta = view.view_model(report)
    return meta.select("solution_path", "solution_name", "project_count", "namespace_count", "project_cycle_count", "namespace_cycle_count")


def _codec_solution(spark, sf_dir):
    """One solution text of nations as projects, regions as folders, made from the tables."""
    nation, region = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "region")
    folder = F.format_string('Project("{2150e333-8fdc-42a3-9474-1a3956d46de8}") = "%s", "%s", "{R%d}"', "r_name", "r_name", "r_regionkey")
    path = F.format_string("%s\\%s%s", F.lower("n_name"), "n_name", F.when(F.col("n_nationkey") % 6 == 5, ".txt").otherwise(".csproj"))
    project = F.format_string('Project("{FAE04EC0}") = "%s", "%s", "{n%d}"', "n_name", path, "n_nationkey")
    nested = F.format_string("\t\t{N%d} = {r%d}", "n_nationkey", "n_regionkey")
    parts = [
        region.select(F.lit(0).alias("s"), F.col("r_regionkey").cast("long").alias("o"), folder.alias("line")),
        nation.select(F.lit(1).alias("s"), F.col("n_nationkey").cast("long").alias("o"), project.alias("line")),
        spark.createDataFrame([(2, 0, "Global"), (2, 1, "\tGlobalSection(NestedProjects) = preSolution"), (4, 0, "\tEndGlobalSection"), (4, 1, "EndGlobal")], "s int, o long, line string"),
        nation.where("n_nationkey % 5 <> 0").select(F.lit(3).alias("s"), F.col("n_nationkey").cast("long").alias("o"), nested.alias("line")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    # The text of one solution file: nations and regions are as many at every scale.
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "o", "line"))), lambda x: x["line"]), "\r\n")
    return whole.agg(text.alias("content")).select(F.lit("/s/world.sln").alias("path"), "content")


def parse_sln_lines(spark, sf_dir):
    return solution.project_entries(solution.solution_lines(_codec_solution(spark, sf_dir))).select("type_guid", "name", "relative_path", "guid")


def parse_nested_projects(spark, sf_dir):
    return solution.nested_parents(solution.solution_lines(_codec_solution(spark, sf_dir))).select("child", "parent")


def solution_projects(spark, sf_dir):
    return solution.classic_projects(_codec_solution(spark, sf_dir)).select("id", "name", "full_path", "relative_path", "group_path")


def _codec_projects(spark, sf_dir):
    """A project text for each part: a package, a reference to the next part, and properties by number."""
    part = b.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    part = part.repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    sdk = F.when(F.col("p_size") % 4 == 0, "Microsoft.NET.Sdk.Web").otherwise("Microsoft.NET.Sdk")
    props = F.concat(
        F.when(F.col("p_size") % 3 == 0, F.lit("<OutputType>Exe</OutputType>")).otherwise(F.lit("")),
        F.when(F.col("p_size") % 5 == 0, F.lit("<UseWPF>True</UseWPF>")).otherwise(F.lit("")),
        F.lit("<TargetFrameworks> ;net"), F.col("p_size").cast("string"), F.lit(" ;net1</TargetFrameworks>"),
    )
    reference = F.format_string('<ProjectReference Include="..\\%d\\%d.csproj"/>', F.col("p_partkey") + 1, F.col("p_partkey") + 1)
    items = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<ItemGroup Condition=\"x\">"), reference, F.lit("</ItemGroup>"))).otherwise(F.concat(F.lit("<ItemGroup>"), reference, F.lit("</ItemGroup>")))
    package = F.format_string('<ItemGroup><PackageReference Include="%s"/><packagereference Update="%s"/></ItemGroup>', "p_brand", F.upper("p_brand"))
    end = F.when(F.col("p_partkey") % 50 == 0, F.lit("</Broken>")).otherwise(F.lit("</Project>"))
    content = F.concat(F.lit('<Project Sdk="'), sdk, F.lit('"><PropertyGroup>'), props, F.lit("</PropertyGroup>"), items, package, end)
    files = part.select("p_partkey", F.format_string("/s/%d/%d.csproj", "p_partkey", "p_partkey").alias("full_path"), F.format_string("P%d", "p_partkey").alias("name"), content.alias("content"))
    return project_xml.load_projects(files)


def parse_project_refs(spark, sf_dir):
    got = _codec_projects(spark, sf_dir).where("error IS NULL").select("p_partkey", F.explode("refs").alias("r"))
    return got.select("p_partkey", F.col("r.target_key").alias("target_key"), F.col("r.is_conditional").alias("is_conditional"))


def parse_package_refs(spark, sf_dir):
    return _codec_projects(spark, sf_dir).where("error IS NULL").select("p_partkey", F.array_join("packages", ",").alias("packages"))


def project_kinds(spark, sf_dir):
    return _codec_projects(spark, sf_dir).select("p_partkey", F.when(F.col("error").isNull(), F.col("kind")).alias("kind"), F.when(F.col("error").isNull(), F.col("target_framework")).alias("framework"), F.col("error").isNotNull().alias("failed"))


def parse_csharp_usings(spark, sf_dir):
    """Sources made from orders: what stands in comments, strings, inactive parts and aliases must not show."""
    # Narrow rows are dealt out before the texts are made of them: the table may be one file.
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    orders = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("// using No.A;\nusing Sys.O"), key, F.lit("; using static Lib.S"), F.col("o_custkey").cast("string"), F.lit('.Type;\nusing X = No.B;\nglobal using G'),
        F.col("o_orderstatus"), F.lit(";\n#if DEBUG\nusing No.C;\n#else\nusing Yes.E;\n#endif\nnamespace A.B"), key,
        F.lit(' { /* namespace No.D; */ class C { string s = "using No.E;"; void M() { using var f = F(); } }\n namespace In { using Late.U; } }\nnamespace A.B'), key, F.lit(" { }"),
    )
    got = csharp.parse_sources(orders.select("o_orderkey", text.alias("content")))
    return got.select("o_orderkey", *[F.array_join(c, ",").alias(c) for c in ("namespaces", "usings", "global_usings")])


def scan_filter_cap(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.struct("source", "doc_id").alias("scan_order"), (F.col("n_chars") * 100).alias("length"))
    first, cut = ns_ops.capped_files(files, 300, 400_000)
    return first.select("doc_id", "length").join(cut, F.lit(True))


def parsed_files_cap(spark, sf_dir):
    """The first 300 sources made from orders that can be read, in order of customer and order; of each third customer none can."""
    orders = b.table(spark, sf_dir, "orders")
    text = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("using U.C"), "o_custkey", F.lit(";\nnamespace N.S"), "o_orderstatus", F.lit(";")))
    files = orders.select("o_orderkey", F.struct("o_custkey", "o_orderkey").alias("scan_order"), F.floor("o_totalprice").alias("length"), text.alias("content"))
    parsed, cut = ns_ops.parsed_files(files, 300, 200_000, csharp.parse_sources)
    return parsed.join(cut, F.lit(True)).select("o_orderkey", *[F.array_join(c, ",").alias(c) for c in ("namespaces", "usings")], "truncated")


def href_references(spark, sf_dir):
    pages = b.table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("references"), F.countDistinct("page_id").alias("pages"))


def namespace_graph(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    nodes = stage(_order_nodes(spark, sf_dir), "order-nodes")
    return DependencyGraph.from_edges(nodes, stage(_order_edges(spark, sf_dir), "order-edges"), "namespace", NAMESPACES)


def namespace_diagram_nodes(spark, sf_dir):
    return namespace_graph(spark, sf_dir).diagram[0].select("node_id", "key", "kind", "group_name", "group_position", "in_cycle", "representative_file")


def namespace_diagram_edges(spark, sf_dir):
    return namespace_graph(spark, sf_dir).diagram[1].select("edge_id", "source_node_id", "target_node_id", "source_name", "target_name", "count", "in_cycle")


def namespace_cycles(spark, sf_dir):
    return namespace_graph(spark, sf_dir).cycles().select("rank", "scope", F.array_join("nodes", ",").alias("nodes"), "length", "scc_id")


def namespace_mermaid(spark, sf_dir):
    return namespace_graph(spark, sf_dir).mermaid()


def namespace_notes(spark, sf_dir):
    """Notes of the namespace graph, its files counted up to a cap of 500, and of a solution without sources and one without C# projects."""
    declared = stage(b.order_declarations(spark, sf_dir), "order-declared")
    files = declared.select("scan_order", F.lit(1).alias("length")).distinct()
    first, cut = ns_ops.capped_files(files, 500, 1)
    graph = namespace_graph(spark, sf_dir)
    drawn, shown = graph.diagram
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = cut.select("truncated", F.lit(500).alias("cap"))
    for part in (
        count(declared.select("project").distinct(), "projects"), count(first, "files"), count(graph.nodes, "namespaces"), count(graph.edges, "dependencies"),
        count(drawn, "drawn"), count(shown, "shown"),
    ):
        # One row each.
        row = row.join(part, F.lit(True))
    row = stage(row, "namespace-numbers")
    bare = row.withColumn("namespaces", F.lit(0).cast("long"))
    cases = row.withColumn("solution", F.lit("whole")).unionByName(bare.withColumn("solution", F.lit("bare")))
    cases = cases.unionByName(bare.withColumn("projects", F.lit(0).cast("long")).withColumn("solution", F.lit("other")))
    return cases.select("solution", F.posexplode(contract.namespace_notes()).alias("position", "note"))


def diagnostic_rows(spark, sf_dir):
    found, listed, drawn = _diagnosed(spark, sf_dir)
    a = diagnostics.project_diagnostics(found, listed, "/work/solution")
    c, _ = diagnostics.namespace_diagnostics(found, drawn)
    return diagnostics.diagnostic_rows(diagnostics.by_file(a.unionByName(c)))


def slnx_projects(spark, sf_dir):
    """One XML solution of nations as projects in folders of their regions; some have no folder, an id or no project's extension."""
    nation, region = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "region")
    path = F.format_string("%s\\%s%s", F.lower("n_name"), "n_name", F.when(F.col("n_nationkey") % 6 == 5, ".txt").otherwise(".csproj"))
    ident = F.when(F.col("n_nationkey") % 4 == 0, F.format_string(' Id="n%d"', "n_nationkey")).otherwise("")
    project = F.format_string('<Project Path="%s"%s/>', path, ident)
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    folder = F.when(F.col("n_nationkey") % 5 == 0, project).otherwise(F.format_string('<Folder Name="%s">%s</Folder>', "r_name", project))
    # The text of one solution file: nations are as many at every scale.
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", folder.alias("x")))), lambda r: r["x"])
    text = named.agg(F.concat(F.lit("<Solution>"), F.array_join(lines, "\n"), F.lit("</Solution>")).alias("content"))
    found = solution.xml_projects(text.select(F.lit("/s/world.slnx").alias("path"), "content"))
    return found.select("id", "name", "full_path", "relative_path", "group_path")


def _report(spark, sf_dir):
    g = nation_graph(spark, sf_dir)
    paths = g.nodes.select("key", F.concat(F.lower("name"), F.lit(".csproj")).alias("relative_path"), F.format_string("net%d", "key").alias("target_framework"))
    outside = edge_ops.reference_counts(b.nation_references(spark, sf_dir), b.nation_nodes(spark, sf_dir))
    return contract.report_row(g, paths, outside, "/s/world.sln")


def report_json(spark, sf_dir):
    """The nested report of the nation graph as one JSON text."""
    return contract.report_text(_report(spark, sf_dir))


def report_reader(spark, sf_dir):
    """What the reader finds in the written report: kinds, hubs, projects and edges in order."""
    path = f"{shared_dir(spark)}/graphloom/report-{uuid.uuid4().hex}"
    contract.report_text(_report(spark, sf_dir)).write.text(path)
    delete_at_exit(spark, path)
    report = contract.read_report(spark, path)

    def part(section: str, listed: str, name: str, first: str, second: str) -> DataFrame:
        rows = report.select(F.posexplode(listed).alias("position", "v"))
        return rows.select(F.lit(section).alias("section"), "position", F.expr(name).alias("name"), F.expr(first).alias("first"), F.expr(second).alias("second"))

    parts = [
        part("edge", "diagramEdges", "concat(v.sourceName, '>', v.targetName)", "v.count", "0L"),
        part("hub", "dependencyHubs", "v.name", "v.outgoingDependencies", "v.incomingDependencies"),
        part("kind", "projectKinds", "v.name", "v.count", "0L"),
        part("project", "projects", "concat_ws(' ', v.name, v.relativePath, v.groupPath, v.kind, v.targetFramework)", "v.outgoingDependencies", "v.packageReferences"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def report_file(spark, sf_dir):
    """A report file of all orders as projects, each customer's orders as a cycle and the large orders as warnings, as its reader finds them."""
    c = F.col
    orders = b.table(spark, sf_dir, "orders").select(F.format_string("o%d", "o_orderkey").alias("name"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    cycles = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("name")).alias("nodes"))
    large = orders.where("o_totalprice >= 300000")
    path = f"{shared_dir(spark)}/graphloom/report-{uuid.uuid4().hex}.json"
    write_report({
        "solutionPath": "/s/orders.sln", "notes": [], "mermaid": "flowchart LR",
        "projects": Rows.of(orders, [c("o_custkey"), c("o_orderkey")], {"name": c("name"), "kind": c("o_orderstatus"), "outgoingDependencies": c("o_custkey")}),
        "warnings": Rows.of(large, [c("o_orderkey")], F.concat(F.lit('large "'), "name", F.lit('"'))),
        "projectCycles": Rows.of(cycles, [c("o_custkey")], {"scope": F.lit("project"), "nodes": c("nodes"), "length": F.size("nodes")}),
        "namespaces": {"notes": [], "cycles": Rows.of(cycles.where("false"), [c("o_custkey")], {"nodes": c("nodes")})},
    }, path, spark)
    delete_at_exit(spark, path)
    sections = {
        "projects": ("'project'", "concat_ws(' ', v.projects.name, v.projects.kind, v.projects.outgoingDependencies)"), "warnings": ("'warning'", "v.warnings"),
        "projectCycles": ("'cycle'", "concat_ws(' ', v.projectCycles.length, array_join(v.projectCycles.nodes, ','))"),
    }
    case = lambda k: F.expr(f"CASE listed {' '.join(f"WHEN '{name}' THEN {values[k]}" for name, values in sections.items())} END")
    return contract.read_elements(spark, path).where(F.col("listed").isin(*sections)).select(case(0).alias("section"), "position", case(1).alias("text"))


def report_notes(spark, sf_dir):
    """Notes and warnings of the nation graph in their order."""
    row = stage(_report(spark, sf_dir), "report-row")
    listed = lambda kind: row.select(F.lit(kind).alias("kind"), F.posexplode(kind).alias("position", "text"))
    return listed("notes").unionByName(listed("warnings"))


def source_scan(spark, sf_dir):
    """Customers' orders written as source trees of 25 projects, then listed, cut by length, read and parsed."""
    top = f"{shared_dir(spark)}/graphloom/source-trees-{uuid.uuid4().hex}"
    part = F.element_at(F.array(*map(F.lit, ("/", "/src/_gen/", "/bin/", "/.hidden/a/", "/deep/er/b/", "/OBJ/x/", "/src/"))), (F.col("o_custkey") % 7 + 1).cast("int"))
    name = F.concat(F.format_string("C%d", "o_custkey"), F.when(F.col("o_custkey") % 11 == 0, ".txt").otherwise(".cs"))
    path = F.concat(F.lit(f"{top}/p"), (F.col("o_custkey") % 25).cast("string"), part, name)
    using = F.concat(F.lit("using O"), F.col("o_orderkey").cast("string"), F.lit(";"))
    bought = b.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", using.alias("u")))).alias("orders"))
    text = F.concat(F.array_join("orders.u", "\n"), F.lit("\nnamespace C"), F.col("o_custkey").cast("string"), F.lit(";"))
    stage(listing.write_files(bought.select(path.alias("path"), text.alias("content"))), "source-trees")
    delete_at_exit(spark, top)
    number = F.col("id").cast("int")
    projects = spark.range(25).select(number.alias("project_order"), F.format_string("p%d", number).alias("project"), F.format_string(f"{top}/p%d", number).alias("folder"))
    files = listing.listed_sources(projects).where("length <= 300")
    parsed = csharp.parse_sources(listing.with_content(files, "file"))
    return parsed.select(
        "project", F.substring("file", len(top) + 2, 1 << 20).alias("file"), "length",
        F.array_join("namespaces", ",").alias("namespaces"), F.array_join("usings", ",").alias("usings"),
    )


def solution_pick_list(spark, sf_dir):
    """Parts as solutions in folders named by type, with accents and upper case here and there: the first 100 of the list."""
    part = b.table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.translate(F.lower("p_brand"), "a", "ä")).when(F.col("p_partkey") % 3 == 1, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    relative = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("/"), name, F.lit("/p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".sln"))
    return listing.pick_list(part.select(F.concat(F.lit("/s/"), relative).alias("path"), relative.alias("relative_path")))


NAMES = [
    project_edges, external_conditional_counts, node_degrees, dependency_hubs_top6, kind_summary, report_totals, top_nodes, visible_edges,
    packages_distinct_ci, target_framework_pick, group_path_recursive, scc_components, scc_distributed, cycle_nodes, cycle_edges, cycles,
    namespace_edges, namespace_group_kind, representative_file, namespace_top_nodes, namespace_dependency_count, diagram_nodes, diagram_edges,
    mermaid_lines, mermaid_text, escape_labels, neighbourhood, neighbourhood_edges, cycle_highlight, cycle_list, cycle_members, cycle_diagnostics_anchored,
    cycle_diagnostics_unanchored, status_messages, view_model_meta, parse_sln_lines, parse_nested_projects, solution_projects, parse_project_refs,
    parse_package_refs, project_kinds, parse_csharp_usings, source_scan, solution_pick_list, scan_filter_cap, parsed_files_cap, href_references, report_json,
    report_reader, report_file, report_notes, slnx_projects, diagnostic_rows, namespace_diagram_nodes, namespace_diagram_edges, namespace_cycles, namespace_mermaid, namespace_notes,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}
