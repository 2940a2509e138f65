"""A whole analysis of a small solution, with answers derived by hand."""

from __future__ import annotations

import json

import pytest
from golden import write_solution

from graphloom.options import AnalyzeOptions, parse_arguments, positive_int
from graphloom.plans.contract import read_report
from graphloom.plans.report import AnalysisError, analyze, main

MERMAID = """flowchart LR
  subgraph G0["src"]
    P0["Shop.Core\\nlibrary"]
    P1["Shop.Data\\nlibrary"]
    P2["Shop.Web\\nweb"]
  end
  subgraph G1["test/Shop.Tests"]
    P3["Shop.Tests\\ntest"]
  end
  P1 E0@--> P0
  P0 E1@--> P1
  P3 E2@--> P2
  P2 E3@--> P0
  P2 E4@--> P1
  style P0 stroke:#e5484d,stroke-width:2px
  style P1 stroke:#e5484d,stroke-width:2px
  linkStyle 0,1 stroke:#e5484d,stroke-width:2px"""


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    return analyze(spark, write_solution(tmp_path_factory.mktemp("shop")))


def test_projects(report):
    c = report.content
    assert (c["projectCount"], c["totalDependencies"], c["totalPackageReferences"], c["testProjectCount"]) == (4, 6, 4, 1)
    assert [(h["name"], h["packageReferences"]) for h in c["dependencyHubs"]] == [("Shop.Data", 1), ("Shop.Core", 0), ("Shop.Web", 1), ("Shop.Tests", 2)]
    assert [(p["name"], p["groupPath"], p["targetFramework"]) for p in c["projects"]] == [
        ("Shop.Core", "src", "net8.0"), ("Shop.Data", "src", "net8.0"), ("Shop.Tests", "test/Shop.Tests", "net8.0"), ("Shop.Web", "src", "net8.0"),
    ]
    assert [(k["name"], k["count"]) for k in c["projectKinds"]] == [("library", 2), ("test", 1), ("web", 1)]
    assert [(e["sourceName"], e["targetName"], e["count"]) for e in c["diagramEdges"]] == [
        ("Shop.Data", "Shop.Core", 2), ("Shop.Core", "Shop.Data", 1), ("Shop.Tests", "Shop.Web", 1), ("Shop.Web", "Shop.Core", 1), ("Shop.Web", "Shop.Data", 1),
    ]
    assert c["mermaid"] == MERMAID
    assert c["projectCycles"] == [{"scope": "project", "nodes": ["Shop.Core", "Shop.Data"], "length": 2}]


def test_namespaces(report):
    n = report.content["namespaces"]
    assert (n["namespaceCount"], n["dependencyCount"]) == (5, 6)
    assert [(e["sourceName"], e["targetName"], e["count"]) for e in n["diagramEdges"]] == [
        ("Shop.Core", "Shop.Core.Util", 2), ("Shop.Core", "Shop.Data", 1), ("Shop.Data", "Shop.Core", 1),
        ("Shop.Tests", "Shop.Web", 1), ("Shop.Web", "Shop.Core", 1), ("Shop.Web", "Shop.Data", 1),
    ]
    assert [x["name"] for x in n["diagramNodes"]] == ["Shop.Core", "Shop.Core.Util", "Shop.Data", "Shop.Tests", "Shop.Web"]
    assert [x["kind"] for x in n["diagramNodes"]] == ["library", "library", "library", "test", "web"]
    assert [x["representativeFile"].split("/", 4)[-1].rsplit("/", 1)[-1] for x in n["diagramNodes"]] == ["Order.cs", "Text.cs", "Repo.cs", "T.cs", "Home.cs"]
    assert n["mermaid"].endswith("linkStyle 1,2 stroke:#e5484d,stroke-width:2px")
    assert n["notes"][1] == "Parsed 7 C# source file(s) across 4 C# project(s)."


def test_notes_and_warnings(report):
    assert report.content["notes"] == ["PackageReference nodes are summarized only: 4 package reference(s) across 4 project(s)."]
    assert report.content["warnings"] == [
        "1 project reference(s) point outside the selected solution and are summarized as externals.",
        "1 conditional ProjectReference item(s) were detected and may vary by configuration.",
        "1 circular project-dependency group(s) detected involving 2 project(s).",
        "1 circular namespace-dependency group(s) detected across 5 namespace(s).",
    ]


def test_diagnostics(spark, report):
    files, loose = report.diagnostics(spark)
    got = {r["file"].rsplit("/", 1)[-1]: r["messages"] for r in files.collect()}
    assert got["Shop.Core.csproj"] == ["Project 'Shop.Core' participates in a dependency cycle: Shop.Core → Shop.Data → Shop.Core"]
    assert set(got) == {"Shop.Core.csproj", "Shop.Data.csproj", "Order.cs", "Repo.cs"}
    assert loose.count() == 0


def test_cut(spark, tmp_path):
    c = analyze(spark, write_solution(tmp_path), AnalyzeOptions(2, 1)).content
    assert [n["name"] for n in c["diagramProjects"]] == ["Shop.Core", "Shop.Data"]
    assert [(e["sourceName"], e["targetName"]) for e in c["diagramEdges"]] == [("Shop.Data", "Shop.Core")]
    assert c["notes"][:2] == ["Diagram truncated to the top 2 projects out of 4 total.", "Showing the top 1 project reference edges out of 5 total."]


def test_bad_project_and_command_line(spark, tmp_path):
    path = write_solution(tmp_path)
    (tmp_path / "src/Shop.Web/Shop.Web.csproj").write_text("<Project>")
    main(["--solution", path, "--output", str(tmp_path / "out/report.json"), "--max-projects", "x"], spark)
    c = json.loads((tmp_path / "out/report.json").read_text())
    read = read_report(spark, str(tmp_path / "out")).first().asDict(True)
    assert read == c
    assert c["projectCount"] == 3
    assert c["warnings"][0].startswith("Failed to parse project 'Shop.Web': ")
    assert "2 project reference(s) point outside" in c["warnings"][1]


def test_xml_solution(spark, tmp_path):
    write_solution(tmp_path)
    path = tmp_path / "Shop.slnx"
    path.write_text(
        '<Solution><Folder Name="/src/"><Project Path="src/Shop.Core/Shop.Core.csproj" /><Project Path="src\\Shop.Data\\Shop.Data.csproj"/></Folder>'
        '<Project Path="test/Shop.Tests/Shop.Tests.csproj" Id="x"/><Project Path="SRC/Shop.Core/Shop.Core.csproj"/><Project Path="a.txt"/></Solution>'
    )
    c = analyze(spark, str(path)).content
    assert [(p["name"], p["groupPath"]) for p in c["projects"]] == [("Shop.Core", "/src/"), ("Shop.Data", "/src/"), ("Shop.Tests", "test/Shop.Tests")]
    assert c["notes"][0] == "The selected .slnx file was parsed through XML project discovery."


def test_nothing_to_analyze(spark, tmp_path):
    with pytest.raises(AnalysisError):
        analyze(spark, " ")
    with pytest.raises(FileNotFoundError):
        analyze(spark, str(tmp_path / "no.sln"))
    (tmp_path / "a.txt").write_text("")
    with pytest.raises(AnalysisError):
        analyze(spark, str(tmp_path / "a.txt"))
    (tmp_path / "empty.sln").write_text("")
    c = analyze(spark, str(tmp_path / "empty.sln")).content
    assert c["mermaid"] == 'flowchart LR\n  Empty["No projects found"]'
    assert c["notes"] == ["No supported project files were found in the selected solution."]


def test_options():
    assert parse_arguments(["x", "--A", "1", "--b", "--a", "2"]) == {"a": "2", "b": "true"}
    assert [positive_int(v, 7) for v in ("3", "0", "-1", "x", None)] == [3, 7, 7, 7, 7]
