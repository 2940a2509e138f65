"""Every registered query of the graph engine against DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from graphloom.plans import oracles, queries

SF = "/root/testdata/sf0.001"
NAMES = list(queries.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def test_every_query_but_the_report_has_sql():
    assert set(NAMES) - set(oracles.oracle_sql()) == {"report_json"}


@pytest.mark.parametrize("name", [n for n in NAMES if n != "report_json"])
def test_same_rows(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.sql(oracles.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(str, got.select(*columns).toPandas().astype(object).itertuples(index=False, name=None)))
    expected = sorted(map(str, want.df()[columns].astype(object).itertuples(index=False, name=None)))
    assert rows == expected


def test_report_json(spark):
    import json

    report = json.loads(queries.report_json(spark, SF).first()["report"])
    assert report["projectCount"] == 20 and report["solutionName"] == "world"
    assert len(report["diagramProjects"]) == 8 and len(report["projects"]) == 20
    assert report["namespaces"]["diagramNodes"] == [] and report["projectKinds"][0]["count"] >= report["projectKinds"][-1]["count"]
    assert report["mermaid"].startswith("flowchart LR\n  subgraph G0")
