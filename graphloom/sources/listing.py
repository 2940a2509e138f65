"""Files of source trees on any store: listed, read and written by the executors.

Spark's own listing leaves out names that start with a dot or underscore,
which belong to a source tree, and runs on the driver. Here the folders still
to be listed are a table: a task lists a folder and what lies below it until
it has seen ``STEP`` entries, and hands back the folders that it did not
reach, which are spread over all tasks in the next round.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.staging import stage

#: Folders that are not descended into, in any case, and those outside which solutions are looked for.
IGNORED = ("bin", "obj", ".git", ".vs", "node_modules", "packages")
SOLUTIONS_OUTSIDE = ("node_modules", "bin", "obj")
SOLUTIONS_OFFERED = 100
#: Entries that a task lists below one folder before it hands back the rest.
STEP = 4096
_ROWS = 1024
#: Characters of files that are handed on at once, about.
_CHARS = 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """The store of ``path``, the path within it, and what stands before that in ``path``."""
    if "://" not in path:
        path, before = path.removeprefix("file:"), "file:" if path.startswith("file:") else ""
        return fs.LocalFileSystem(), path, before
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: path.rindex(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


def is_file(path: str) -> bool:
    store, inner, _ = located(path)
    return store.get_file_info(inner).type == fs.FileType.File


def _entries(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What lies in a folder; nothing where it is missing or cannot be read. Linked folders may form loops and are left out."""
    try:
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    except OSError:
        return []
    if not isinstance(store, fs.LocalFileSystem):
        return found
    return [e for e in found if e.type != fs.FileType.Directory or not os.path.islink(e.path)]


def list_files(folders: DataFrame, suffix: str, ignored: tuple[str, ...] = IGNORED, any_case: bool = False, step: int = STEP) -> DataFrame:
    """``folders`` (folder, ...) with a row for each file below that ends with ``suffix``: (..., file, length).

    Folders named in ``ignored`` (in any case) are not descended into; one
    that is listed itself always is. Null, missing and unreadable folders
    hold no files. A folder that stands in several rows is listed for each.
    ``any_case`` compares the suffix without regard to case.
    """
    kept = [c for c in folders.columns if c != "folder"]
    end = suffix.lower() if any_case else suffix
    types = dict(folders.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "file string, length long"])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # A row at a time: what one folder yields is bounded by the step and by what lies directly in a folder.
            for k in range(len(frame)):
                row = frame.iloc[k : k + 1]
                start = row["folder"].iloc[0]
                if start is None:
                    continue
                store, inner, before = located(start)
                ahead, found, seen = [inner], [], 0
                while ahead and seen < step:
                    for e in _entries(store, ahead.pop()):
                        seen += 1
                        if e.type == fs.FileType.Directory:
                            if e.base_name.lower() not in ignored:
                                ahead.append(e.path)
                        elif (e.base_name.lower() if any_case else e.base_name).endswith(end):
                            found.append((before + e.path, e.size))
                # No length marks a folder that is left for the next round.
                found += [(before + f, None) for f in ahead]
                for a in range(0, len(found), _ROWS):
                    part = pd.DataFrame(found[a : a + _ROWS], columns=["file", "length"]).astype({"length": "Int64"})
                    for c in kept:
                        part[c] = pd.Series([row[c].iloc[0]] * len(part), dtype=row[c].dtype)
                    yield part[[*kept, "file", "length"]]

    spark = folders.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ahead, rounds = folders, []
    while True:
        # By number, as few small rows would else be gathered into one task.
        listed = stage(ahead.select(*kept, "folder").repartition(tasks, "folder").mapInPandas(walk, schema), "listed-files")
        rounds.append(listed.where("length IS NOT NULL"))
        ahead = listed.where("length IS NULL").select(*kept, F.col("file").alias("folder"))
        if ahead.isEmpty():
            return reduce(DataFrame.unionByName, rounds)


def find_solutions(spark: SparkSession, folder: str, limit: int = SOLUTIONS_OFFERED) -> DataFrame:
    """``(position, path, relative_path)`` of up to ``limit`` solution files under a folder, outside build and package folders.

    They come in the order of a language's alphabet (case and accents decide
    only between names that are else alike), and then by path.
    """
    root = spark.createDataFrame([(folder.rstrip("/"),)], "folder string")
    found = list_files(root, ".sln", SOLUTIONS_OUTSIDE, any_case=True)
    return pick_list(found.select(F.col("file").alias("path"), F.substring("file", len(folder.rstrip("/")) + 2, 1 << 30).alias("relative_path")), limit)


def pick_list(solutions: DataFrame, limit: int = SOLUTIONS_OFFERED) -> DataFrame:
    """``solutions`` (path, relative_path) cut to the first ``limit`` in the order of ``find_solutions``, with their position from 0."""
    order = [F.collate("relative_path", "UNICODE"), F.col("relative_path"), F.col("path")]
    # The limit is the feature: the window runs on what it has left.
    first = solutions.orderBy(*order).limit(limit)
    return first.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("position"), "path", "relative_path")


def listed_sources(projects: DataFrame) -> DataFrame:
    """``(project_order, project, file, length, scan_order)`` of all sources of ``projects`` (project_order, project, folder)."""
    return list_files(projects.select("project_order", "project", "folder"), ".cs").selectExpr("*", "struct(project_order, file) AS scan_order")


def contents(frames: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Rows with the texts of their files, handed on by size: of long texts one is in memory, and short ones do not go one by one."""
    for frame in frames:
        texts, size, first = [], 0, 0
        for k, path in enumerate(frame[column]):
            text = None
            try:
                store, inner, _ = located(path or "")
                with store.open_input_stream(inner) as f:
                    text = f.read().decode("utf-8-sig", errors="replace")
            except OSError:
                pass
            texts.append(text)
            size += len(text or "")
            if size >= _CHARS or k + 1 == len(frame):
                rows = frame.iloc[first : k + 1]
                yield rows.assign(content=pd.Series(texts, index=rows.index, dtype=object))
                texts, size, first = [], 0, k + 1


def with_content(files: DataFrame, column: str) -> DataFrame:
    """``files`` with the text of the file named in ``column``; null where it cannot be read."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return contents(frames, column)

    return files.mapInPandas(read, f"{', '.join(f'`{n}` {t}' for n, t in files.dtypes)}, content string")


def write_files(files: DataFrame) -> DataFrame:
    """Write each text of ``files`` (path, content) to its path, folders included: ``(path, length)`` in bytes, once it is run.

    A task that is run again writes the same files again. Rows with a null are passed over.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: set[str] = set()
        for frame in frames:
            done = []
            for path, text in zip(frame["path"], frame["content"], strict=True):
                if path is None or text is None:
                    continue
                store, inner, before = located(path)
                # Most files share a folder with others; the set is emptied before it grows large.
                if (folder := before + posixpath.dirname(inner)) not in made:
                    store.create_dir(posixpath.dirname(inner), recursive=True)
                    made = made if len(made) < STEP else set()
                    made.add(folder)
                content = text.encode()
                with store.open_output_stream(inner) as f:
                    f.write(content)
                done.append((path, len(content)))
            yield pd.DataFrame(done, columns=["path", "length"])

    return files.select("path", "content").mapInPandas(write, "path string, length long")
