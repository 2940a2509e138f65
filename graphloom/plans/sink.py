"""A report of any size as one JSON file: its long arrays stay tables until they stand in the file."""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.listing import located
from graphloom.staging import shared_dir

_CHUNK = 1 << 20


@dataclass
class Rows:
    """An array of a report: the column ``v`` of a table, in the order of its other columns."""

    table: DataFrame

    @staticmethod
    def of(df: DataFrame, order: list[Column], fields: dict[str, Column] | Column) -> Rows:
        """``fields`` is a struct's fields by name, or a column for an array of plain values."""
        v = fields if isinstance(fields, Column) else F.struct(*[c.alias(k) for k, c in fields.items()])
        return Rows(df.select(*[o.alias(f"o{i}") for i, o in enumerate(order)], v.alias("v")))

    @property
    def order(self) -> list[str]:
        return [c for c in self.table.columns if c != "v"]

    def _texts(self, df: DataFrame) -> DataFrame:
        # A value alone has no JSON text, so it is written as an array of one.
        return df.select(F.to_json(F.array("v"), {"ignoreNullFields": "false"}).alias("value"))

    def collect(self) -> list:
        """The whole array on the driver, for who wants to read it there."""
        return [json.loads(r["value"])[0] for r in self._texts(self.table.orderBy(*self.order)).toLocalIterator()]

    def write(self, folder: str, depth: int) -> None:
        """Elements as indented text, each after a line's end and before a comma, in files whose names follow the order."""
        pad = "\n" + "  " * depth

        def indented(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                whole = [json.dumps(json.loads(x)[0], indent=2, ensure_ascii=False).replace("\n", pad) for x in frame["value"]]
                yield pd.DataFrame({"value": [pad + x for x in whole]}, dtype=object)

        # Equal keys meet in one range, so the order of ranges and within them is the order of all.
        ranged = self.table.repartitionByRange(*self.order).sortWithinPartitions(*self.order)
        self._texts(ranged).mapInPandas(indented, "value string").write.option("lineSep", ",").text(folder)


def gathered(content: object) -> object:
    """``content`` with its tables collected."""
    if isinstance(content, dict):
        return {k: gathered(v) for k, v in content.items()}
    return content.collect() if isinstance(content, Rows) else content


def _marked(content: object, found: list[tuple[str, Rows, int]], depth: int = 1) -> object:
    if isinstance(content, dict):
        return {k: _marked(v, found, depth + 1) for k, v in content.items()}
    if isinstance(content, Rows):
        found.append((uuid.uuid4().hex, content, depth))
        return found[-1][0]
    return content


def _parts(folder: str) -> list[tuple[str, int]]:
    store, inner, before = located(folder)
    listed = store.get_file_info(fs.FileSelector(inner))
    return [(before + e.path, e.size) for e in sorted(listed, key=lambda e: e.path) if e.base_name.startswith("part-") and e.size]


def _layout(pieces: list[tuple[str, str | None, int]]) -> list[tuple[bytes | str, int]]:
    """What stands in a file, one after the other: texts, and names of parts, each with its length."""
    found: list[tuple[bytes | str, int]] = []
    for text, folder, depth in pieces:
        parts = [] if folder is None else _parts(folder)
        found.append((whole := (text + ("" if folder is None else "[")).encode(), len(whole)))
        # The last element has no comma behind it.
        found += [(path, size - (i == len(parts) - 1)) for i, (path, size) in enumerate(parts)]
        if folder is not None:
            found.append((whole := ("\n" + "  " * (depth - 1) + "]" if parts else "]").encode(), len(whole)))
    return found


def _chunks(path: str, length: int) -> Iterator[bytes]:
    store, inner, _ = located(path)
    with store.open_input_stream(inner) as f:
        while length and (chunk := f.read(min(_CHUNK, length))):
            length -= len(chunk)
            yield chunk


def join_parts(target: str, pieces: list[tuple[str, str | None, int]]) -> None:
    """Write ``pieces``, each a text and the folder of the array behind it, to ``target``, a chunk in memory at a time.

    The file appears under its name when it is whole; what fails leaves
    nothing, and a run that is repeated writes the same.
    """
    store, inner, _ = located(target)
    store.create_dir(posixpath.dirname(inner) or ".", recursive=True)
    temporary = f"{inner}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(temporary) as out:
            for piece, length in _layout(pieces):
                for chunk in [piece] if isinstance(piece, bytes) else _chunks(piece, length):
                    out.write(chunk)
        store.move(temporary, inner)
    except BaseException:
        if store.get_file_info(temporary).type == fs.FileType.File:
            store.delete_file(temporary)
        raise


def join_parts_at_once(spark, target: str, pieces: list[tuple[str, str | None, int]]) -> None:
    """``join_parts`` on a mounted disk that driver and executors share: each part goes to its own place in the file, a task for each."""
    store, inner, _ = located(target)
    store.create_dir(posixpath.dirname(inner) or ".", recursive=True)
    temporary, at, texts, copies = f"{inner}.{uuid.uuid4().hex}", 0, [], []
    for piece, length in _layout(pieces):
        (texts if isinstance(piece, bytes) else copies).append((piece, at, length))
        at += length

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"]:
                path, place, length = copies[i]
                with open(temporary, "r+b") as out:
                    out.seek(place)
                    for chunk in _chunks(path, length):
                        out.write(chunk)
            yield frame

    try:
        with open(temporary, "wb") as out:
            for text, place, _ in texts:
                out.seek(place)
                out.write(text)
        if copies:
            spark.range(0, len(copies), 1, len(copies)).mapInPandas(copy, "id long").agg(F.count("id")).collect()
        os.replace(temporary, inner)
    except BaseException:
        if os.path.exists(temporary):
            os.remove(temporary)
        raise


def write_report(content: dict, path: str, spark) -> None:
    """``content`` as an indented JSON file at ``path``; folders are made.

    Tables in it are written by ranges of their order and joined part by
    part: on the driver where ``path`` is on its disk, by a task for each part
    where it has the scheme of a mounted disk, else in a task.
    """
    found: list[tuple[str, Rows, int]] = []
    text = json.dumps(_marked(content, found), indent=2, ensure_ascii=False)
    top, pieces = f"{shared_dir(spark)}/graphloom/report-{uuid.uuid4().hex}", []
    for i, (mark, rows, depth) in enumerate(found):
        before, text = text.split(f'"{mark}"')
        rows.write(f"{top}/{i}", depth)
        pieces.append((before, f"{top}/{i}", depth))
    pieces.append((text, None, 0))
    try:
        if "://" not in path:
            join_parts(path, pieces)
        elif isinstance(located(path)[0], fs.LocalFileSystem):
            join_parts_at_once(spark, path, pieces)
        else:

            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    for target in frame["path"]:
                        join_parts(target, pieces)
                    yield frame

            spark.createDataFrame([(path,)], "path string").coalesce(1).mapInPandas(run, "path string").collect()
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
