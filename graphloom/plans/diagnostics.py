"""Cycle diagnostics anchored to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import cycle_message, cycle_text, joined_path


def _members(cycles: DataFrame) -> DataFrame:
    """``(rank, pos, name, nodes)`` of all cycles of one scope."""
    return cycles.select("rank", "nodes", F.posexplode("nodes").alias("pos", "name"))


def project_diagnostics(cycles: DataFrame, projects: DataFrame, solution_dir: str) -> DataFrame:
    """``(file, scope_ord, rank, pos, message)`` for cycle members that are projects; others are left out.

    ``projects`` (name, relative_path, ord): of equal names the last counts. Relative paths are put on the solution's folder.
    """
    named = projects.groupBy("name").agg(F.max_by("relative_path", "ord").alias("relative_path"))
    joined = _members(cycles).join(named, "name")
    file = F.when(F.col("relative_path").rlike(r"^(/|[A-Za-z]:[\\/])"), F.col("relative_path")).otherwise(joined_path(F.lit(solution_dir), F.col("relative_path")))
    return joined.select(file.alias("file"), F.lit(0).alias("scope_ord"), "rank", "pos", cycle_message("Project", F.col("name"), F.col("nodes")).alias("message"))


def namespace_diagnostics(cycles: DataFrame, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchored rows, and ``(rank, pos, message)`` of members without a file; only drawn nodes can anchor.

    ``drawn`` (name, representative_file, ord): of equal names the last counts.
    """
    # Wrapped, as a last file that is null must count as null.
    files = drawn.groupBy("name").agg(F.max_by(F.struct("representative_file"), "ord").alias("f"))
    joined = _members(cycles).join(files, "name", "left").withColumn("file", F.col("f.representative_file"))
    known = F.coalesce(F.col("file"), F.lit("")) != ""
    anchored = joined.where(known).select("file", F.lit(1).alias("scope_ord"), "rank", "pos", cycle_message("Namespace", F.col("name"), F.col("nodes")).alias("message"))
    return anchored, joined.where(~known).select("rank", "pos", F.concat("name", F.lit(": "), cycle_text(F.col("nodes"))).alias("message"))


def by_file(anchored: DataFrame) -> DataFrame:
    """``(file, messages)``: a file's messages in the order of the cycles, project cycles first."""
    ordered = F.array_sort(F.collect_list(F.struct("scope_ord", "rank", "pos", "message")))
    return anchored.groupBy("file").agg(F.transform(ordered, lambda x: x["message"]).alias("messages"))


def diagnostic_rows(files: DataFrame, source: str = "graphloom") -> DataFrame:
    """One warning at the top of the file for each message."""
    return files.select("file", F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit("Warning").alias("severity"), F.lit(source).alias("source"), F.explode("messages").alias("message"))
