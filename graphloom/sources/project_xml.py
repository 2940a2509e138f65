"""Project files: references, packages and properties."""

from __future__ import annotations

import posixpath
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import path_key, project_kind, target_framework

from .solution import attribute, local_name

#: The properties that decide kind and framework.
PROPERTIES = ("TargetFramework", "TargetFrameworks", "IsTestProject", "UseWPF", "UseWindowsForms", "OutputType")

SCHEMA = (
    "struct<error:string,sdk:string,packages:array<string>,"
    "refs:array<struct<include:string,full_path:string,is_conditional:boolean>>,"
    + ",".join(f"{p}:string" for p in PROPERTIES)
    + ">"
)


def parse_project(path: str, content: str | None) -> dict:
    """One project file. What cannot be parsed has an ``error`` and nothing else."""
    try:
        if content is None:
            raise FileNotFoundError(f"Could not find file '{path}'.")
        root = ET.fromstring(content.lstrip("﻿"))
    except (ET.ParseError, OSError) as e:
        return {"error": str(e)}
    base = posixpath.dirname(path)
    packages: dict[str, str] = {}
    refs: list[dict] = []

    def visit(element: ET.Element, conditional: bool) -> None:
        conditional = conditional or any(local_name(k).lower() == "condition" for k in element.attrib)
        kind = local_name(element.tag).lower()
        if kind == "packagereference":
            name = attribute(element, "Include")
            name = attribute(element, "Update") if name is None else name
            if name and name.strip():
                packages.setdefault(name.upper(), name)
        elif kind == "projectreference":
            include = attribute(element, "Include")
            if include and include.strip():
                target = posixpath.normpath(posixpath.join(base, include.replace("\\", "/")))
                refs.append({"include": include, "full_path": target, "is_conditional": conditional})
        for child in element:
            visit(child, conditional)

    try:
        visit(root, False)
    except RecursionError as e:
        return {"error": str(e)}
    sdk = root.attrib.get("Sdk")
    if sdk is None:
        named = [attribute(x, "Name") for x in root if local_name(x.tag) == "Sdk"]
        sdk = ";".join(n for n in named if n and n.strip())
    found: dict[str, str | None] = {}
    for name in PROPERTIES:
        hit = next((x for x in root.iter() if local_name(x.tag).lower() == name.lower()), None)
        found[name] = None if hit is None else "".join(hit.itertext()).strip()
    return {"error": None, "sdk": sdk, "packages": [packages[k] for k in sorted(packages)], "refs": refs, **found}


def load_projects(files: DataFrame, path_mode: str = "portable") -> DataFrame:
    """``files`` (full_path, content, ...) with key, kind, framework, packages, references and ``error``."""

    def parse(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = [parse_project(p, c) for p, c in zip(path, content, strict=True)]
        columns = ["error", "sdk", "packages", "refs", *PROPERTIES]
        return pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns)

    # Else a filter on the result would be pushed below it, with a second run of the parser.
    parsed = F.pandas_udf(parse, SCHEMA).asNondeterministic()
    got = files.withColumn("p", parsed("full_path", "content")).drop("content")
    return got.select(
        *[c for c in files.columns if c != "content"],
        path_key(F.col("full_path"), path_mode).alias("key"),
        project_kind(F.col("name"), F.col("p.sdk"), F.col("p.packages"), F.col("p.IsTestProject"), F.col("p.UseWPF"), F.col("p.UseWindowsForms"), F.col("p.OutputType")).alias("kind"),
        target_framework(F.col("p.TargetFramework"), F.col("p.TargetFrameworks")).alias("target_framework"),
        F.col("p.packages").alias("packages"),
        F.transform("p.refs", lambda r: F.struct(r["include"].alias("include"), path_key(r["full_path"], path_mode).alias("target_key"), r["is_conditional"].alias("is_conditional"))).alias("refs"),
        F.col("p.error").alias("error"),
    )


def distinct_packages(packages: DataFrame, by: str, value: str, position: str) -> DataFrame:
    """``(by, package)``: each package once ignoring case, in its first spelling; blank ones go."""
    kept = packages.where(F.trim(value) != "").groupBy(by, F.upper(value).alias("folded"))
    return kept.agg(F.min_by(value, position).alias("package")).drop("folded")
