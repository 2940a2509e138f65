"""Operators and parsers on small cases."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom import DependencyGraph
from graphloom.functions import expressions as ex
from graphloom.operators import namespaces as ns_ops
from graphloom.operators import scc
from graphloom.operators.numbering import numbered
from graphloom.plans import diagnostics, mermaid, view
from graphloom.sources import csharp, listing, solution
from graphloom.sources.csharp import holds, parse_sources
from graphloom.sources.project_xml import load_projects, parse_project
from graphloom.staging import stage


def by_reachability(edges: set[tuple[int, int]], n: int) -> dict[int, int]:
    reach = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            reach[a] |= reach[b]
    return {i: min(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n)}


def scc_of(spark, edges, n):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "key int")
    table = spark.createDataFrame(sorted(edges), "source_key int, target_key int")
    return {r["key"]: r["scc_id"] for r in scc.components(nodes, table).collect()}


def test_components_are_mutual_reachability(spark):
    """Many graphs at once, as parts of one: sparse ones with long paths, dense ones, loops; each alone by reachability."""
    rng = random.Random(1)
    edges, want = set(), {}
    for k in range(60):
        n, at = rng.randint(1, 12), 12 * k
        part = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([n // 2, n, n + 2, 2 * n, 3 * n]))}
        edges |= {(at + a, at + b) for a, b in part}
        want |= {at + i: at + c for i, c in by_reachability(part, n).items()} | {at + i: at + i for i in range(n, 12)}
    assert scc_of(spark, edges, 720) == want


def test_components_of_one_graph(spark):
    rng = random.Random(1)
    n = 25
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(40)}
    assert scc_of(spark, edges, n) == by_reachability(edges, n)


def test_rounds_follow_the_logarithm_of_the_length(spark, monkeypatch):
    """A ring of 100,000 nodes in random order, a path into it, a path out of it, and a ring with shortcuts."""
    rng = random.Random(5)
    n = 100_000
    order = list(range(n))
    rng.shuffle(order)
    edges = [(order[i], order[(i + 1) % n]) for i in range(n)]
    edges += [(n + i, n + i + 1) for i in range(5000)] + [(n + 5000, order[0]), (order[7], 2 * n)] + [(2 * n + i, 2 * n + i + 1) for i in range(5000)]
    rounds = []
    plain = scc.stage
    monkeypatch.setattr(scc, "stage", lambda df, name: rounds.append(name) or plain(df, name))
    table = spark.createDataFrame(pd.DataFrame(edges, columns=["source_key", "target_key"]))
    got = scc.components(spark.range(1).select(F.col("id").alias("key")), table).toPandas().set_index("key")["scc_id"]
    assert (got.loc[range(n)] == 0).all()
    rest = got.loc[[k for k in got.index if k >= n]]
    assert (rest == rest.index).all() and len(rest) == 5001 + 5001
    assert len(rounds) <= 120, len(rounds)


def test_ring_alone(spark, monkeypatch):
    rounds = []
    plain = scc.stage
    monkeypatch.setattr(scc, "stage", lambda df, name: rounds.append(name) or plain(df, name))
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("source_key"), ((F.col("id") + 1) % n).alias("target_key"))
    got = scc.components(ring.select(F.col("source_key").alias("key")), ring)
    assert got.where("scc_id = 0").count() == n
    assert len(rounds) <= 60


def graph(spark, nodes, edges):
    return DependencyGraph.from_edges(spark.createDataFrame(nodes, "key string, name string, group_path string"), spark.createDataFrame(edges, "source_key string, target_key string, count long"))


def test_self_edge_is_a_cycle_and_counts_twice(spark):
    g = graph(spark, [("a", "A", ""), ("b", "B", " ")], [("a", "a", 2), ("a", "b", 1)])
    assert [(r["nodes"], r["length"]) for r in g.cycles().collect()] == [(["A"], 1)]
    assert {r["key"]: (r["outgoing"], r["incoming"]) for r in g.degrees().collect()} == {"a": (3, 2), "b": (0, 1)}


def test_underscore_groups_come_after_letters(spark):
    g = graph(spark, [("1", "x", "a_b"), ("2", "y", "aBc"), ("3", "z", "A1"), ("4", "w", "ABC")], [("1", "2", 1)])
    positions = {r["key"]: r["group_position"] for r in g.diagram[0].collect()}
    assert positions == {"3": 0, "2": 1, "4": 1, "1": 2}


def test_empty_diagrams(spark):
    none = graph(spark, [], [])
    assert none.mermaid().first()["mermaid"] == 'flowchart LR\n  Empty["No nodes found"]'
    alone = graph(spark, [("a", "A<", "")], [])
    assert alone.mermaid().first()["mermaid"] == (
        'flowchart LR\n  subgraph G0["(solution root)"]\n    P0["A&lt;\\nlibrary"]\n  end\n  EmptyLink["No dependencies found"]'
    )
    assert mermaid.empty_text("No projects found") == 'flowchart LR\n  Empty["No projects found"]'


def test_folder_loop_ends(spark):
    parents = spark.createDataFrame([("p", "a"), ("a", "b"), ("b", "a")], "child string, parent string")
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, name string")
    got = solution.group_paths(spark.createDataFrame([("p",), ("q",)], "child string"), parents, names)
    assert {r["child"]: r["group_path"] for r in got.collect()} == {"p": "B/A", "q": ""}


@pytest.mark.parametrize(
    ("name", "kind"), [("Latest", "test"), ("A.Tests.B", "test"), ("MyTests", "test"), ("Plain", "library"), ("Testing", "library")]
)
def test_kind_by_name(spark, name, kind):
    none = F.lit(None).cast("string")
    made = ex.project_kind(F.lit(name), F.lit("Microsoft.NET.Sdk"), F.array().cast("array<string>"), none, none, none, none)
    assert spark.range(1).select(made.alias("k")).first()["k"] == kind


def test_project_xml_traps():
    got = parse_project("/s/a/a.csproj", "﻿<Project Sdk='X'><PropertyGroup><TargetFramework/><TARGETFRAMEWORKS>n1</TARGETFRAMEWORKS></PropertyGroup></Project>")
    assert (got["TargetFramework"], got["TargetFrameworks"], got["error"]) == ("", "n1", None)
    assert parse_project("/s/a.csproj", "<Project>")["error"]
    assert parse_project("/s/a.csproj", None)["error"]
    twice = parse_project("/s/a/a.csproj", "<Project><ItemGroup><ProjectReference Include='..\\b\\b.csproj'/><ProjectReference Include='../b/b.csproj' Condition='x'/></ItemGroup></Project>")
    assert [(r["full_path"], r["is_conditional"]) for r in twice["refs"]] == [("/s/b/b.csproj", False), ("/s/b/b.csproj", True)]


CSHARP = [
    ("namespace A { namespace B.C { } } namespace A { }", ["A", "A.B.C"], [], []),
    ("namespace A; class X { string s = \"using No;\"; }", ["A"], [], []),
    ("using global::A.B; using X = C; using static D.E; using static F; namespace N { using G; }", ["N"], ["global::A.B", "D", "G"], []),
    ("#if X\nusing No;\n#elif !X && (Y || true)\nusing Yes;\n#else\nusing No2;\n#endif\n#define Z\n#if Z\nusing Z1;\n#endif", [], ["Yes", "Z1"], []),
    ('var s = """\nusing No;\n"""; var t = $"{(true ? "}" : "a")} using No;"; var u = @"a""; using No;"; char c = \'"\';\nusing var d = X();', [], [], []),
    ("/* using No; */ // using No;\nusing Yes;", [], ["Yes"], []),
    ("class C { void M() { using (var x = f()) { } using var y = g(); } }", [], [], []),
    ("[assembly: X] namespace A { }", ["A"], [], []),
    ("global using A.B; global using static C.D; using E;", [], ["E"], ["A.B", "C"]),
    ("\ufeffusing A;\r\n#region x\r\nnamespace @B . C /* c */ { using unsafe static D.E.F<int>; }", ["B.C"], ["A", "D.E"], []),
    # What is open when a line with a # comes: it is no directive there.
    ('/*\n#if A\n*/ using A; var s = @"x""\n#if B\n"; using B; var r = """" """\n  #else\n """"; using C;', [], ["A", "B", "C"], []),
    # Nothing in inactive code is open; conditions nest.
    ("#if A\n/* don't \" @\"\n#if true\nusing No;\n#else\nusing No;\n#endif\n#elif false\n#else\nusing Yes;\n#endif\nusing Last;", [], ["Yes", "Last"], []),
    ("#define A // c\n#define B\n#undef B\n#if A == !B && (A != B) && !(B || !A)\nusing Yes;\n#endif\n#if A && (B\nusing No;\n#endif\n#if B == B == A || B\nusing Too;\n#endif", [], ["Yes", "Too"], []),
    ('class A { string f = $"{x:{y}}}} {$"{a}{"}"}"}"; char q = \'\\\'\'; } namespace N { class B { namespace No { } } using Late; } using No', ["N"], ["Late"], []),
    ("using A; } namespace B { } { using No; } using C; using = ; using static ; using ;", ["B"], ["A", "C"], []),
    ('var a = $@"{x} ""; using No; {{ #"; using A; var b = "open\nusing No2 = 1;\n\'\nusing B;', [], ["A"], []),
    ("namespace A.B", [], [], []),
    ("", [], [], []),
    (None, None, None, None),
]


def test_csharp(spark):
    files = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CSHARP)], "i int, content string")
    parsed = parse_sources(files)
    got = {r["i"]: (r["namespaces"], r["usings"], r["global_usings"]) for r in parsed.collect()}
    assert got == {i: c[1:] for i, c in enumerate(CSHARP) if c[0] is not None}
    # Every text is parsed once, and in the JVM.
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowScan", "")


def test_conditions_by_evaluation(spark):
    """Random conditions against the language's own operators of one precedence after the other."""
    rng = random.Random(4)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["A", "B", "true", "false", "!A", "!!B"])
        kind = rng.random()
        if kind < 0.3:
            return f"({made(depth - 1)})"
        return f"{made(depth - 1)} {rng.choice(['&&', '||', '==', '!='])} {made(depth - 1)}"

    def value(text):
        """By repeated splitting at the loosest operator outside brackets."""
        text = text.strip()
        for mark in ("||", "&&"):
            depth, parts, last = 0, [], 0
            for i in range(len(text)):
                depth += (text[i] == "(") - (text[i] == ")")
                if depth == 0 and text[i : i + 2] == mark:
                    parts.append(text[last:i])
                    last = i + 2
            if parts:
                values = [value(p) for p in [*parts, text[last:]]]
                return any(values) if mark == "||" else all(values)
        depth = 0
        for i in range(len(text) - 1, 0, -1):
            depth += (text[i] == ")") - (text[i] == "(")
            if depth == 0 and text[i - 1 : i + 1] in ("==", "!="):
                return (value(text[: i - 1]) == value(text[i + 1 :])) == (text[i - 1] == "=")
        if text[0] == "!":
            return not value(text[1:])
        if text[0] == "(":
            return value(text[1:-1])
        return text in ("A", "true")

    conditions = [made(4) for _ in range(400)]
    df = spark.createDataFrame([(c,) for c in conditions], "c string").repartition(4)
    got = {r["c"]: r["v"] for r in df.select("c", holds(F.col("c"), F.array(F.lit("A"))).alias("v")).collect()}
    assert got == {c: value(c) for c in conditions}


def test_long_source(spark):
    """Cost in proportion to a text, and no deep stacks: a method of many blocks, a very long comment and literal, many directives."""
    body = "class K { void M() { " + "if (x) { y(); } " * 20_000 + "} }"
    text = "using A;\n" + "#if X\nusing No;\n#endif\n" * 500 + "/*" + "*" * 300_000 + "*/ var s = @\"" + '""' * 100_000 + '"; var t = "' + "\\\\" * 100_000 + '";\n' + body + "\nnamespace N { }"
    got = parse_sources(spark.createDataFrame([(text,)], "content string")).first()
    assert (got["namespaces"], got["usings"]) == (["N"], ["A"])


def test_members_of_a_large_cycle(spark):
    n = 300_000
    cyclic = spark.range(n).select(F.col("id").alias("key"), F.when(F.col("id") < 5, 1).otherwise(5).alias("scc_id"))
    nodes = spark.range(n).where("id <> 7").select(F.col("id").alias("key"), F.format_string("m%06d", F.lit(n) - F.col("id")).alias("name"))
    got = scc.cycle_members(cyclic, nodes, 1000).toPandas().sort_values(["scc_id", "position"])
    names = sorted("7" if i == 7 else f"m{n - i:06d}" for i in range(5, n))
    large, small = got[got.scc_id == 5], got[got.scc_id == 1]
    assert list(large["name"]) == names and list(large["position"]) == list(range(n - 5)) and (large["chunk"] == large["position"] // 1000).all()
    assert list(small["name"]) == [f"m{n - i:06d}" for i in (4, 3, 2, 1, 0)]


def test_projects_are_parsed_once(spark):
    files = spark.createDataFrame([("/s/a.csproj", "A", "<Project/>"), ("/s/b.csproj", "B", "<")], "full_path string, name string, content string")
    good = load_projects(files).where("error IS NULL")
    assert [r["name"] for r in good.collect()] == ["A"]
    assert good._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize(("most", "bad"), [(5, 3), (5, 1), (40, 2), (1, 5), (30, 2)])
def test_files_that_fail_do_not_count(spark, most, bad):
    """``bad`` = 1: none parses."""
    rows = [(i, (i * 7) % 60, 10 if i % 4 else 99) for i in range(60)]
    files = spark.createDataFrame(rows, "i int, scan_order int, length long").repartition(3)
    parsed, cut = ns_ops.parsed_files(files, most, 50, lambda batch: batch.where(f"i % {bad} <> 0").select("i", "scan_order"))
    walk = sorted((o, i, size) for i, o, size in rows)
    good = [(o, i) for o, i, size in walk if size <= 50 and i % bad][:most]
    assert sorted((r["scan_order"], r["i"]) for r in parsed.collect()) == good
    assert cut.first()["truncated"] == (len(good) == most and any(o > good[-1][0] for o, _, _ in walk))


def test_no_files(spark):
    none = spark.createDataFrame([], "i int, scan_order int, length long")
    parsed, cut = ns_ops.parsed_files(none, 3, 50, lambda batch: batch.select("i", "scan_order"))
    assert parsed.collect() == [] and not cut.first()["truncated"]


def edges_by_file(declared, usings, shared):
    """Every file's namespaces against all that it uses, its project's global usings among them."""
    known, files, found = {ns for _, _, ns in declared}, {}, {}
    for record, project, ns in declared:
        files.setdefault((record, project), set()).add(ns)
    for (record, project), spaces in files.items():
        used = {t for r, t in usings if r == record} | {t for p, t in shared if p == project}
        for s in spaces:
            for t in (used & known) - {s}:
                found[s, t] = found.get((s, t), 0) + 1
    return found


@pytest.mark.parametrize("seed", range(3))
def test_namespace_edges_by_file(spark, seed):
    rng = random.Random(seed)
    # Most files are of one project.
    project = {r: "hot" if rng.random() < 0.7 else f"p{r % 3}" for r in range(60)}
    declared = [(r, project[r], f"n{rng.randrange(8)}") for r in range(55) for _ in range(rng.randint(1, 3))]
    usings = [(rng.randrange(60), f"n{rng.randrange(10)}") for _ in range(150)]
    shared = [(rng.choice(["hot", "p0", "p1", "none"]), f"n{rng.randrange(10)}") for _ in range(14)]
    got = ns_ops.namespace_edges(
        spark.createDataFrame(declared, "record int, project string, ns string"), spark.createDataFrame(usings + usings[:5], "record int, target string"),
        spark.createDataFrame(shared + shared[:3], "project string, target string"),
    )
    assert {(r["source_key"], r["target_key"]): r["count"] for r in got.collect()} == edges_by_file(declared, usings, shared)


def test_global_usings_are_not_spread_over_files(spark):
    """One project of 4,000 files with 300 global usings: no join gives files times usings."""
    declared = spark.range(4000).select(F.col("id").alias("record"), F.lit("hot").alias("project"), F.format_string("n%d", F.col("id") % 20).alias("ns"))
    declared = declared.unionByName(spark.range(300).select((F.col("id") + 5000).alias("record"), F.lit("other").alias("project"), F.format_string("g%d", "id").alias("ns")))
    shared = spark.range(300).select(F.lit("hot").alias("project"), F.format_string("g%d", "id").alias("target"))
    usings = spark.range(4000).select(F.col("id").alias("record"), F.lit("g1").alias("target"))
    edges = ns_ops.namespace_edges(declared, usings, shared)
    got = edges.collect()
    assert len(got) == 20 * 300 and {r["count"] for r in got} == {200}

    def rows(node):
        metrics = node.metrics()
        here = metrics.apply("numOutputRows").value() if "Join" in node.nodeName() and metrics.contains("numOutputRows") else 0
        inner = [node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        children = node.children()
        return max([here, *map(rows, inner), *(rows(children.apply(i)) for i in range(children.size()))])

    assert 0 < rows(edges._jdf.queryExecution().executedPlan()) < 20_000


def cycles(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "rank int, nodes array<string>")


def test_project_diagnostics(spark):
    listed = spark.createDataFrame(
        [("Mill", "old/Mill.csproj", 0), ("Forge", "/far/Forge.csproj", 1), ("Mill", "new/../new/Mill.csproj", 2), ("Quarry", "q.csproj", 3)],
        "name string, relative_path string, ord int",
    )
    rows = diagnostics.project_diagnostics(cycles(spark, [["Forge", "Mill", "Unlisted"], ["Quarry"], []]), listed, "/home/works")
    got = diagnostics.by_file(rows)
    ring = "Forge → Mill → Unlisted → Forge"
    assert {r["file"]: r["messages"] for r in got.collect()} == {
        "/far/Forge.csproj": [f"Project 'Forge' participates in a dependency cycle: {ring}"],
        "/home/works/new/Mill.csproj": [f"Project 'Mill' participates in a dependency cycle: {ring}"],
        "/home/works/q.csproj": ["Project 'Quarry' participates in a dependency cycle: Quarry → Quarry"],
    }
    shown = diagnostics.diagnostic_rows(got).where("file = '/home/works/q.csproj'").first()
    assert (shown["line"], shown["col"], shown["severity"]) == (0, 0, "Warning")


def test_namespace_diagnostics(spark):
    drawn = spark.createDataFrame(
        [("River.Upper", "/u.cs", 0), ("River.Lower", "/first.cs", 1), ("River.Lower", "/last.cs", 2), ("Lake", None, 3)], "name string, representative_file string, ord int"
    )
    anchored, loose = diagnostics.namespace_diagnostics(cycles(spark, [["Lake", "River.Lower", "River.Upper"], ["Undrawn"]]), drawn)
    assert sorted(r["file"] for r in anchored.collect()) == ["/last.cs", "/u.cs"]
    assert sorted(r["message"] for r in loose.collect()) == ["Lake: Lake → River.Lower → River.Upper → Lake", "Undrawn: Undrawn → Undrawn"]


def test_numbers_along_an_order(spark):
    rows = [(i * 7919 % 1000,) for i in range(1000)]
    table = spark.createDataFrame(rows, "x int").repartition(7)
    got = numbered(table, [F.desc("x")], "rank").collect()
    assert {r["x"]: r["rank"] for r in got} == {x: 1000 - x for x in range(1000)}
    assert numbered(table.where("x < 0"), [F.desc("x")], "rank").count() == 0


def test_solutions_found(spark, tmp_path):
    for name in ("b/two.SLN", "a/one.sln", "bin/no.sln", "a/obj/no.sln", "node_modules/x/no.sln", "a/no.slnx", "a/no.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    found = listing.find_solutions(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["position"], r["path"], r["relative_path"]) for r in found] == [(i, f"{tmp_path}/{n}", n) for i, n in enumerate(("a/one.sln", "b/two.SLN"))]
    assert listing.find_solutions(spark, f"file://{tmp_path}/", 1).first()["relative_path"] == "a/one.sln"


def test_solutions_in_the_order_of_the_alphabet(spark):
    rows = [(f"/{n}", n) for n in ("zoo.sln", "Äpfel.sln", "apfel.sln", "Apfel.sln", "Zebra.sln", "äpfel.sln", "birne.sln", "birne.sln")]
    got = listing.pick_list(spark.createDataFrame(rows, "path string, relative_path string")).orderBy("position").collect()
    assert [r["relative_path"] for r in got] == ["apfel.sln", "Apfel.sln", "äpfel.sln", "Äpfel.sln", "birne.sln", "birne.sln", "Zebra.sln", "zoo.sln"]
    assert listing.pick_list(spark.createDataFrame([], "path string, relative_path string")).count() == 0


def _tree(top, names):
    for name in names:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(name)


def test_source_trees(spark, tmp_path):
    kept = ["a.cs", "_b/.c/d.cs", ".e/f.cs", "binary/g.cs", "h/i/j/k.cs"]
    _tree(tmp_path, [*kept, "BIN/l.cs", "h/obj/m.cs", ".git/n.cs", "h/Packages/o.cs", "p.CS", "q.cs.txt"])
    (tmp_path / "h/loop").symlink_to(tmp_path, target_is_directory=True)
    folders = [(0, "A", str(tmp_path)), (1, "B", f"{tmp_path}/h"), (2, "C", f"{tmp_path}/missing"), (3, "D", None), (4, None, f"{tmp_path}/h"), (5, "E", f"{tmp_path}/BIN")]
    rows = spark.createDataFrame(folders, "project_order int, project string, folder string")
    got = sorted(((r["project_order"], r["project"], r["file"][len(str(tmp_path)) + 1 :], r["length"]) for r in listing.listed_sources(rows).collect()), key=str)
    inner = ("h/i/j/k.cs", len("h/i/j/k.cs"))
    want = [(0, "A", n, len(n)) for n in kept] + [(1, "B", *inner), (4, None, *inner), (5, "E", "BIN/l.cs", 8)]
    assert got == sorted(want, key=str)
    assert listing.listed_sources(rows.limit(0)).count() == 0


def test_source_trees_in_several_rounds(spark, tmp_path):
    names = [f"{'/'.join(str(i >> s & 3) for s in (4, 2, 0))}/f{i}.cs" for i in range(64)]
    _tree(tmp_path, names)
    root = spark.createDataFrame([(f"file://{tmp_path}",)], "folder string")
    got = [r["file"] for r in listing.list_files(root, ".cs", step=3).collect()]
    assert sorted(got) == sorted(f"file://{tmp_path}/{n}" for n in names)


def test_files_written_and_read(spark, tmp_path):
    texts = {f"{tmp_path}/x/é.cs": "ä\r\nb", f"{tmp_path}/y.cs": "\ufeffusing A;", f"file://{tmp_path}/z.cs": ""}
    rows = spark.createDataFrame([*texts.items(), (None, "a"), ("/b", None)], "path string, content string")
    assert {r["path"]: r["length"] for r in listing.write_files(rows).collect()} == {p: len(t.encode()) for p, t in texts.items()}
    paths = spark.createDataFrame([(p,) for p in [*texts, f"{tmp_path}/none", None]], "path string")
    got = {r["path"]: r["content"] for r in listing.with_content(paths, "path").collect()}
    assert got == {**{p: t.removeprefix("\ufeff") for p, t in texts.items()}, f"{tmp_path}/none": None, None: None}


def test_windows_paths(spark):
    files = spark.createDataFrame(
        [("P", "/S/Lib/A.csproj", '<Project><ItemGroup><ProjectReference Include="..\\Core\\B.csproj"/></ItemGroup></Project>')], "name string, full_path string, content string"
    )
    for mode, key, target in (("portable", "/S/Lib/A.csproj", "/S/Core/B.csproj"), ("windows", "/s/lib/a.csproj", "/s/core/b.csproj")):
        row = load_projects(files, mode).first()
        assert (row["key"], row["refs"][0]["target_key"]) == (key, target)


def test_view_model_defaults(spark):
    m = view.view_model(spark.createDataFrame([("/a.sln",)], "solution_path string")).first()
    assert (m["solution_path"], m["solution_name"], m["project_count"], m["namespace_count"], m["project_cycle_count"], m["warnings"]) == ("/a.sln", "", 0, 0, 0, [])
    assert m["projects"]["mermaid"] == "" and m["namespaces"]["nodes"] == []


def test_view_model_counts(spark):
    made = spark.sql(
        "select 5 project_count, array('A-B', 'C-D') project_cycles, array('w') warnings, array('n', 'm') notes, "
        "struct(3 as namespace_count, 'x' as mermaid, array('X') as diagram_nodes, array('E') as diagram_edges, array('X,Y') as cycles) namespaces, "
        "'flow' mermaid, array('A') diagram_projects, array('E') diagram_edges"
    )
    m = view.view_model(made).first()
    assert (m["project_count"], m["namespace_count"], m["project_cycle_count"], m["namespace_cycle_count"]) == (5, 3, 2, 1)
    assert (m["warnings"], m["notes"], m["projects"]["mermaid"], m["namespaces"]["nodes"]) == (["w"], ["n", "m"], "flow", ["X"])


def _walk(child, parents, names):
    met, path = [child], []
    while (up := parents.get(met[-1])) is not None and up in names and up not in met:
        met.append(up)
        path.insert(0, names[up])
    return "/".join(path)


@pytest.mark.parametrize("seed", range(4))
def test_folder_paths_as_walked(spark, seed):
    draw = random.Random(seed)
    n = 60
    # Few keys without a parent, so loops of all lengths with tails, loops of one, and missing names.
    parents = {f"k{i}": f"k{draw.randrange(n) if draw.random() < 0.7 else i}" if draw.random() < 0.3 else f"k{min(n, i + 1)}" for i in range(n) if draw.random() < 0.97}
    names = {f"k{i}": f"n{i % 50}" for i in range(n + 1) if draw.random() < 0.97}
    children = [f"k{i}" for i in range(n + 2)] + ["k1"]
    got = solution.group_paths(
        spark.createDataFrame([(c,) for c in children], "child string"), spark.createDataFrame([*parents.items()], "child string, parent string"),
        spark.createDataFrame([*names.items()], "key string, name string"),
    ).collect()
    assert sorted((r["child"], r["group_path"]) for r in got) == sorted((c, _walk(c, parents, names)) for c in children)


def test_deep_folders_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(solution, "stage", lambda df, name: rounds.append(name) or stage(df, name))
    ids = spark.range(10_000).select(F.format_string("k%d", "id").alias("child"), F.format_string("k%d", F.col("id") + 1).alias("parent"))
    one = lambda *rows: spark.createDataFrame(rows, "child string")
    got = solution.group_paths(one(("k9000",), ("k9999",), ("k10000",)), ids, ids.select("parent", F.lit("f")))
    assert {r["child"]: len(r["group_path"]) for r in got.collect()} == {"k9000": 1999, "k9999": 1, "k10000": 0}
    assert len(rounds) <= 20


def test_blocks_of_code_are_one_token(spark):
    """What lies in a type's braces is passed over at once, as far as the pattern reaches, and by its braces beyond that."""
    code = "class A { void M() { if (x) { y(); } } int P { get; set; } } namespace N { class B { } using U; } class C { }"
    block = code[8 : code.index(" namespace N")]
    deep = "class D { a { b { c { d { namespace No.N { using No.U; } } } using No.V; } } }\nusing Not;\nnamespace E;\nusing W;"
    df = spark.createDataFrame([(code + deep,)], "content string")
    tokens = df.select(F.regexp_extract_all("content", F.lit(csharp._STRUCTURE), F.lit(0))).first()[0]
    assert tokens[0] == block and [t for t in tokens if t.startswith("{ void") or t == "{ }"] == [block, "{ }", "{ }"]
    got = parse_sources(df).first()
    assert (got["namespaces"], got["usings"]) == (["N", "E"], ["U", "Not", "W"])


def test_many_directives_and_declarations(spark):
    lines = [f'#if A{i % 2}\nusing No{i};\n#else\nusing Yes{i}; // {{\n#endif\nnamespace N{i} {{ class C {{ string s = @"'
             f'\n#if not\n"; }} }}' for i in range(50)]
    got = parse_sources(spark.createDataFrame([("#define A1\n" + "\n".join(lines),)], "content string")).first()
    assert got["usings"] == [f"{'No' if i % 2 else 'Yes'}{i}" for i in range(50)]
    assert got["namespaces"] == [f"N{i}" for i in range(50)]


def test_short_files_are_handed_on_together(tmp_path):
    texts = ["x" * 10] * 300 + ["y" * listing._CHARS] * 2 + ["z"]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}").write_text(t)
    frame = pd.DataFrame({"path": [f"{tmp_path}/{i}" for i in range(len(texts))] + [None], "n": range(len(texts) + 1)}, index=range(7, len(texts) + 8))
    parts = list(listing.contents(iter([frame]), "path"))
    assert [len(p) for p in parts] == [301, 1, 2]
    assert [(n, t) for p in parts for n, t in zip(p["n"], p["content"])] == list(enumerate([*texts, None]))
