"""From declarations and usings of files to a namespace graph.

A file record is one (project, file) pair; a file that two projects hold
counts in both.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.staging import stage


def effective_usings(declared: DataFrame, usings: DataFrame, global_usings: DataFrame) -> DataFrame:
    """``(record, target)``: a file's own usings and its project's global ones, each once.

    ``declared`` (record, project, ns), ``usings`` (record, target) and
    ``global_usings`` (project, target). Only files that declare a namespace
    get global ones.
    """
    shared = declared.select("record", "project").distinct().join(global_usings.distinct(), "project").select("record", "target")
    return usings.select("record", "target").union(shared).distinct()


def namespace_edges(declared: DataFrame, usings: DataFrame, global_usings: DataFrame) -> DataFrame:
    """``(source_key, target_key, count)``: file records in which the source is declared and the known target used.

    Global usings are never spread over files: a project's files that declare
    the source are counted once, and that count holds for each of its global
    targets. What a file uses itself counts only where its project has no
    such global using. So nothing grows with files times global usings,
    however many files one project has.
    """
    known = declared.select(F.col("ns").alias("target")).distinct()
    spaces = declared.select("record", "project", F.col("ns").alias("source_key")).distinct()
    shared = global_usings.select("project", "target").distinct().join(known, "target", "left_semi")
    files = spaces.groupBy("project", "source_key").agg(F.count(F.lit(1)).alias("n"))
    widely = files.join(shared, "project").where("source_key <> target").select("source_key", "target", "n")
    own = usings.select("record", "target").distinct().join(known, "target", "left_semi").join(spaces, "record").where("source_key <> target")
    own = own.join(shared, ["project", "target"], "left_anti").groupBy("source_key", "target").agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(widely).groupBy("source_key", F.col("target").alias("target_key")).agg(F.sum("n").alias("count"))


def owning_projects(declared: DataFrame) -> DataFrame:
    """``(ns, project, declarations)``: the project with most declaring files, of equal ones the first by name."""
    counts = declared.groupBy("ns", "project").agg(F.countDistinct("record").alias("declarations"))
    # A minimum over (-count, name) is the largest count and then the smallest name, without sorting a namespace's rows.
    best = counts.groupBy("ns").agg(F.min(F.struct((-F.col("declarations")).alias("n"), "project")).alias("b"))
    return best.select("ns", F.col("b.project").alias("project"), (-F.col("b.n")).alias("declarations"))


def representative_files(declared: DataFrame) -> DataFrame:
    """``(ns, representative_file)``: the first declaring file by scan order (project order, then path)."""
    return declared.groupBy("ns").agg(F.min_by("file", "scan_order").alias("representative_file"))


def namespace_nodes(declared: DataFrame, project_kinds: DataFrame) -> DataFrame:
    """Nodes of all declared namespaces: group and kind are those of the owning project, else ``namespace``.

    ``project_kinds`` is (project, kind, ord); of projects with one name the last counts.
    """
    kinds = project_kinds.groupBy("project").agg(F.max_by("kind", "ord").alias("kind"))
    owned = owning_projects(declared).join(kinds, "project", "left").join(representative_files(declared), "ns")
    return owned.select(
        F.col("ns").alias("key"),
        F.col("ns").alias("name"),
        F.coalesce("kind", F.lit("namespace")).alias("kind"),
        F.col("project").alias("group_path"),
        F.lit(0).alias("package_references"),
        "representative_file",
    )


def capped_files(files: DataFrame, most: int, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The scanned files, and one row saying whether the scan was cut short.

    ``files`` has ``scan_order`` (unique and sortable) and ``length``. Files
    over ``max_bytes`` do not count towards the cap, but one that comes after
    it cuts the scan short as well.
    """
    fitting = files.where(F.col("length") <= max_bytes)
    # The cap is the feature; a top-k, so no task sorts all files.
    first = fitting.orderBy("scan_order").limit(most)
    last = first.agg(F.max("scan_order").alias("last"), F.count(F.lit(1)).alias("n"))
    beyond = files.join(last, F.lit(True)).where((F.col("n") >= most) & (F.col("scan_order") > F.col("last")))
    return first, beyond.agg((F.count(F.lit(1)) > 0).alias("truncated"))


def parsed_files(files: DataFrame, most: int, max_bytes: int, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` files that parse, as ``parse`` returns them, and one row saying whether the scan was cut short.

    ``parse`` gets some of the files and returns rows with their
    ``scan_order`` for those that parse. Others do not count towards the cap:
    for each of them a further file is taken, in order, until the cap is
    full or no file is left. Every refill asks for twice as many files, so a
    tree of files that fail takes few rounds. Otherwise as ``capped_files``.
    """
    fitting = files.where(F.col("length") <= max_bytes)
    rounds: list[DataFrame] = []
    after: DataFrame | None = None
    have, ask = 0, most
    while have < most:
        rest = fitting if after is None else fitting.join(after, F.lit(True)).where("scan_order > last").drop("last")
        batch = stage(rest.orderBy("scan_order").limit(ask), "files-batch")
        good = stage(parse(batch), "files-parsed")
        taken = batch.agg(F.max("scan_order").alias("last"), F.count(F.lit(1)).alias("n")).first()["n"]
        found = good.count()
        if have + found >= most:
            # What was asked for beyond the cap is put back.
            good = stage(good.orderBy("scan_order").limit(most - have), "files-parsed")
            after = stage(good.agg(F.max("scan_order").alias("last")), "files-last")
        elif taken:
            after = stage(batch.agg(F.max("scan_order").alias("last")), "files-last")
        rounds.append(good)
        have = min(most, have + found)
        if taken < ask:
            break
        ask *= 2
    parsed = reduce(DataFrame.unionByName, rounds)
    if have < most:
        return parsed, files.sparkSession.range(1).select(F.lit(False).alias("truncated"))
    beyond = files.join(after, F.lit(True)).where("scan_order > last")
    return parsed, beyond.agg((F.count(F.lit(1)) > 0).alias("truncated"))
