"""Solution files: classic text (native expressions) and XML (an Arrow UDF)."""

from __future__ import annotations

import posixpath
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.expressions import ROOT_GROUP, extension, joined_path
from graphloom.staging import stage

#: Fixed values of the file format.
FOLDER_TYPE = "{2150E333-8FDC-42A3-9474-1A3956D46DE8}"
PROJECT_EXTENSIONS = (".csproj", ".fsproj", ".vbproj", ".vcxproj")
PROJECT_LINE = r'^Project\("(\{[^"]+\})"\)\s*=\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"(\{[^"]+\})"'
NESTED_LINE = r"^\s*(\{[^}]+\})\s*=\s*(\{[^}]+\})\s*$"


def solution_lines(files: DataFrame) -> DataFrame:
    """``(path, line_no, line)`` of ``files`` (path, content)."""
    lines = F.split(F.regexp_replace("content", "^﻿", ""), r"\r\n|\r|\n")
    return files.select("path", lines.alias("lines")).select("path", F.posexplode("lines").alias("line_no", "line"))


def _sectioned(lines: DataFrame) -> DataFrame:
    """Lines with whether they stand in the section of nested projects."""
    mark = F.when(F.col("line").rlike(r"^\s*GlobalSection\(NestedProjects\)"), True).when(F.col("line").rlike(r"^\s*EndGlobalSection"), False)
    # A file's lines are in one task, as its text was.
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("mark", mark).withColumn("nested", F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(False)))


def project_entries(lines: DataFrame) -> DataFrame:
    """``(path, line_no, type_guid, name, relative_path, guid)`` of project lines; of one GUID the last counts."""
    outside = _sectioned(lines).where(~F.col("nested"))
    found = outside.where(F.col("line").rlike(PROJECT_LINE)).select(
        "path", "line_no", *[F.regexp_extract("line", PROJECT_LINE, i + 1).alias(n) for i, n in enumerate(("type_guid", "name", "relative_path", "guid"))]
    )
    last = found.groupBy("path", F.upper("guid").alias("g")).agg(F.max_by(F.struct("line_no", "type_guid", "name", "relative_path", "guid"), "line_no").alias("e"))
    return last.select("path", "e.*")


def nested_parents(lines: DataFrame) -> DataFrame:
    """``(path, child, parent)`` with upper-case GUIDs; the last parent counts."""
    inside = _sectioned(lines).where("nested").where(F.col("line").rlike(NESTED_LINE))
    found = inside.select("path", "line_no", *[F.upper(F.regexp_extract("line", NESTED_LINE, i + 1)).alias(n) for i, n in enumerate(("child", "parent"))])
    return found.groupBy("path", "child").agg(F.max_by("parent", "line_no").alias("parent"))


#: Steps that pointers grow by in each written round of ``group_paths``: fourfold.
_HOPS = 3


def _cycles(link: DataFrame) -> DataFrame | None:
    """``(at, low)``: folders that lie on loops, with the least key of their loop; None where there are none.

    Pointers reach four times as far in each round, and what comes to an end
    drops out. A chain that ends has a folder of every length up to its own,
    so a round in which none drops out leaves only what leads into loops; as
    soon as the reach is no less than their number, pointers are on loops and
    the least key seen is the loop's.
    """
    state = link.select("at", F.col("parent").alias("to"), F.least("at", "parent").alias("low"))
    reach, before, left = 1, None, state.count()
    while left and (before != left or reach < left):
        once = state.select(F.col("at").alias("to"), F.col("to").alias("next"), F.col("low").alias("next_low"))
        for _ in range(_HOPS):
            state = state.join(once, "to").select("at", F.col("next").alias("to"), F.least("low", "next_low").alias("low"))
        state = stage(state, "folder-reach")
        reach, before, left = reach * (_HOPS + 1), left, state.count()
    if not left:
        return None
    return stage(state.join(state.select(F.col("to").alias("at")).distinct(), "at", "left_semi").select("at", "low"), "folder-loops")


def group_paths(children: DataFrame, parents: DataFrame, names: DataFrame, separator: str = "/") -> DataFrame:
    """``(child, group_path)``: names of all ancestors, outermost first.

    ``children`` (child), ``parents`` (child, parent; one each), ``names``
    (key, name). A walk ends at a parent without a name or one that it has met
    before. Rounds grow with the logarithm of the depth: a folder's path so
    far is joined to the path of the folder it has reached. A loop is cut
    behind its least key; who walks into it goes on, after that key, as far
    as the place where it came in.
    """
    link = stage(parents.join(names.toDF("parent", "parent_name"), "parent").select(F.col("child").alias("at"), "parent", "parent_name"), "folder-links")
    loops = _cycles(link)
    none = F.array().cast("array<string>")
    if loops is None:
        start = link.withColumn("low", F.lit(None).cast("string"))
    else:
        start = link.join(loops, "at", "left")
    cut = F.coalesce(F.col("at") == F.col("low"), F.lit(False))
    state = stage(start.select(
        "at", F.when(~cut, F.col("parent")).alias("to"), F.when(cut, none).otherwise(F.array("parent_name")).alias("path"),
        F.when(F.col("low").isNotNull(), F.col("at")).alias("entry"),
    ), "folder-paths")
    while not state.where("to IS NOT NULL").isEmpty():
        once = state.select(F.col("at").alias("to"), F.col("to").alias("next"), F.col("path").alias("above"), F.col("entry").alias("next_entry"))
        for _ in range(_HOPS):
            state = state.join(once, "to", "left").select(
                "at", F.col("next").alias("to"), F.concat(F.coalesce("above", none), "path").alias("path"), F.coalesce("entry", "next_entry").alias("entry")
            )
        state = stage(state, "folder-paths")
    whole = state.select("at", "path")
    if loops is not None:
        # Round each loop once, from its least key: what follows that key, innermost last.
        first = link.join(loops.where("at = low"), "at").select("low", F.col("parent").alias("at"), "parent_name")
        rounds = first.join(whole, "at").select("low", F.concat("path", F.array("parent_name")).alias("round"))
        came = loops.join(whole, "at").join(rounds, "low").select(F.col("at").alias("entry"), "round", (F.size("round") - 1 - F.size("path")).alias("n"))
        more = F.when(F.col("n") > 0, F.slice("round", F.size("round") - F.col("n") + 1, F.col("n"))).otherwise(none)
        whole = state.join(came.select("entry", more.alias("more")), "entry", "left").select("at", F.concat(F.coalesce("more", none), "path").alias("path"))
    found = children.select("child").join(whole.withColumnRenamed("at", "child"), "child", "left")
    return found.select("child", F.coalesce(F.array_join("path", separator), F.lit("")).alias("group_path"))


def supported(path: Column) -> Column:
    return (F.trim(F.coalesce(path, F.lit(""))) != "") & extension(F.replace(path, F.lit("\\"), F.lit("/"))).isin(*PROJECT_EXTENSIONS)


def fallback_group(relative: Column) -> Column:
    """A project's folder, or the name of the root."""
    folder = F.regexp_extract(F.replace(relative, F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1)
    return F.when(F.trim(folder) == "", ROOT_GROUP).otherwise(folder)


def classic_projects(files: DataFrame) -> DataFrame:
    """``(path, id, name, full_path, relative_path, group_path)`` of all supported projects of ``.sln`` files."""
    lines = stage(solution_lines(files), "solution-lines")
    entries = stage(project_entries(lines), "solution-entries")
    folders = entries.where(F.upper("type_guid") == FOLDER_TYPE)
    wanted = entries.where((F.upper("type_guid") != FOLDER_TYPE) & supported(F.col("relative_path")))
    key = lambda c: F.concat_ws("|", "path", F.upper(c))
    parents = nested_parents(lines).select(F.concat_ws("|", "path", "child").alias("child"), F.concat_ws("|", "path", "parent").alias("parent"))
    grouped = group_paths(wanted.select(key("guid").alias("child")), parents, folders.select(key("guid").alias("key"), "name"))
    base = F.regexp_extract("path", r"^(?:file:)?(.*)/[^/]*$", 1)
    relative = F.replace(F.col("relative_path"), F.lit("\\"), F.lit("/"))
    return wanted.withColumn("child", key("guid")).join(grouped, "child", "left").select(
        "path", F.col("guid").alias("id"), "name", joined_path(base, relative).alias("full_path"), relative.alias("relative_path"),
        F.when(F.coalesce("group_path", F.lit("")) == "", fallback_group(relative)).otherwise(F.col("group_path")).alias("group_path"),
    )


_XML_ROWS = "array<struct<id:string,name:string,full_path:string,relative_path:string,group_path:string>>"


def local_name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attribute(element: ET.Element, name: str) -> str | None:
    """The first attribute of that name in any case, else the first child's text."""
    for k, v in element.attrib.items():
        if local_name(k).lower() == name.lower():
            return v
    for child in element:
        if local_name(child.tag).lower() == name.lower():
            return "".join(child.itertext())
    return None


def _location(element: ET.Element) -> str | None:
    return next((v for n in ("Path", "Include", "FilePath") if (v := attribute(element, n)) is not None), None)


def xml_projects_of(path: str, content: str) -> list[dict]:
    """Projects of one XML solution; of equal paths (in any case) the first counts."""
    root = ET.fromstring(content.lstrip("﻿"))
    base, out, seen = posixpath.dirname(path.removeprefix("file:")), [], set()

    def visit(element: ET.Element, above: list[ET.Element]) -> None:
        for child in element:
            if local_name(child.tag).lower() == "project":
                add(child, [*above, element])
            visit(child, [*above, element])

    def add(element: ET.Element, above: list[ET.Element]) -> None:
        relative = (_location(element) or "").replace("\\", "/")
        if not relative.strip() or posixpath.splitext(relative)[1].lower() not in PROJECT_EXTENSIONS:
            return
        full = posixpath.normpath(posixpath.join(base, relative))
        if full.lower() in seen:
            return
        seen.add(full.lower())
        folders = []
        for x in above:
            name = attribute(x, "Name")
            like = "folder" in local_name(x.tag).lower() or (name is not None and _location(x) is None)
            if like and (name or "").strip():
                folders.append(name)
        folder = "/".join(folders) or posixpath.dirname(relative)
        out.append({
            "id": attribute(element, "Id") or full, "name": attribute(element, "Name") or posixpath.splitext(posixpath.basename(full))[0],
            "full_path": full, "relative_path": relative, "group_path": folder if folder.strip() else ROOT_GROUP,
        })

    visit(root, [])
    return out


def xml_projects(files: DataFrame) -> DataFrame:
    """The same columns as ``classic_projects`` from ``.slnx`` files."""

    @F.pandas_udf(_XML_ROWS)
    def parsed(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([xml_projects_of(p, c) for p, c in zip(path, content, strict=True)])

    return files.select("path", F.explode(parsed("path", "content")).alias("p")).select("path", "p.*")
