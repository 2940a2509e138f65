"""Report files whose arrays are tables."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from graphloom.plans import sink
from graphloom.plans.contract import read_elements
from graphloom.plans.sink import Rows, gathered, write_report
from graphloom.sources.long_json import array_elements


def content_of(spark, n):
    table = spark.range(n).select(((F.col("id") * 7919) % 1009).alias("x"), F.concat(F.lit('é"\\\n\0,['), F.col("id").cast("string")).alias("s"))
    none = F.lit(None).cast("string")
    return {
        "name": 'a "quoted" näme', "few": [1, {"b": None}], "none": [],
        "rows": Rows.of(table, [F.col("x")], {"x": F.col("x"), "text": F.col("s"), "nothing": none, "list": F.array(F.col("x"), F.col("x"))}),
        "inner": {"texts": Rows.of(table, [-F.col("x")], F.col("s")), "empty": Rows.of(table.where("x < 0"), [F.col("x")], F.col("s")), "last": 1},
        "one": Rows.of(table.where("x = 0"), [F.col("x")], {"x": F.col("x")}),
    }


def expected(n):
    rows = sorted((i * 7919 % 1009, f'é"\\\n\0,[{i}') for i in range(n))
    return {
        "name": 'a "quoted" näme', "few": [1, {"b": None}], "none": [],
        "rows": [{"x": x, "text": s, "nothing": None, "list": [x, x]} for x, s in rows],
        "inner": {"texts": [s for _, s in reversed(rows)], "empty": [], "last": 1},
        "one": [{"x": x} for x, _ in rows if x == 0],
    }


@pytest.mark.parametrize("before", ["", "file://"])
def test_file_as_if_written_whole(spark, tmp_path, before):
    n = 1000
    write_report(content_of(spark, n), f"{before}{tmp_path}/a/b/report.json", spark)
    assert os.listdir(tmp_path / "a/b") == ["report.json"]
    assert (tmp_path / "a/b/report.json").read_text() == json.dumps(expected(n), indent=2, ensure_ascii=False)


def test_gathered_is_what_the_file_holds(spark):
    assert gathered(content_of(spark, 50)) == expected(50)


def test_what_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "report.json").write_text("old")
    monkeypatch.setattr(sink, "_parts", lambda folder: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        write_report(content_of(spark, 5), str(tmp_path / "report.json"), spark)
    assert os.listdir(tmp_path) == ["report.json"] and (tmp_path / "report.json").read_text() == "old"


NASTY = {
    "first": [], "text": 'a [ "b\\" : [', "projects": [{"name": f'p\\{"\\" * (i % 5)}"],[{{{i}', "kind": None, "outgoingDependencies": i} for i in range(40)],
    "inner": {"projects": [1, 2, {"x": [3]}], "none": {}}, "warnings": ["", "[", 'é"', "\\\\"] * 9, "nothing": None, "notes": [],
    "projectCycles": [{"scope": "project", "nodes": [f"n{k}" for k in range(200 * (i == 1))], "length": i} for i in range(3)], "number": 5,
}


@pytest.mark.parametrize("form", [{"indent": 2, "ensure_ascii": False}, {"separators": (",", ":")}, {"indent": 1}])
@pytest.mark.parametrize("width", [97, 1013, 1 << 24])
def test_arrays_by_ranges_of_the_file(spark, tmp_path, form, width):
    """Wherever ranges begin, in strings and escapes too, elements are those of the whole file, each once and in its place."""
    path = f"{tmp_path}/report.json"
    with open(path, "w") as f:
        json.dump(NASTY, f, **form)
    want = sorted((k, i, json.dumps(x)) for k, v in NASTY.items() if isinstance(v, list) for i, x in enumerate(v))
    got = array_elements(spark, path, width).collect()
    assert sorted((r["listed"], r["position"], json.dumps(json.loads(r["value"]))) for r in got) == want
    read = read_elements(spark, f"file://{path}", width).where("listed = 'projects'").select("position", "v.projects.name").collect()
    assert sorted((r["position"], r["name"]) for r in read) == [(i, p["name"]) for i, p in enumerate(NASTY["projects"])]


def test_no_task_reads_a_whole_report_file(spark, tmp_path):
    """A long file has a task for each range, in reading and (on a mounted disk) in joining its parts."""
    path = f"{tmp_path}/report.json"
    write_report(content_of(spark, 1000), f"file://{path}", spark)
    assert array_elements(spark, path, 1 << 12).rdd.getNumPartitions() == -(-os.path.getsize(path) // (1 << 12)) > 10
