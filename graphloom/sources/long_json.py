"""Arrays of a JSON file of any size, read by ranges of its bytes.

A file is cut into ranges, and every pass is a task for each. The first pass
counts quotes and brackets, by which the driver knows for every range whether
it begins in a string, and how deep. The second one counts elements, so each
range knows its array and the place there. The third hands out the elements,
each as text by the range in which it begins; that task reads on until it
ends. No task holds more than a range and an element.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.listing import located

#: Bytes of a file that a task reads.
RANGE = 1 << 24
_BACK = 1 << 12
_AHEAD = 1 << 16
_ROWS = 4096
_KIND = np.zeros(256, np.int8)
_KIND[[ord(c) for c in "[{"]], _KIND[[ord(c) for c in "]}"]], _KIND[ord(",")] = 1, -1, 2
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)


def _edge(f, at: int, size: int) -> int:
    """The first place from ``at`` on that no backslash stands before, so that it begins no second half of an escape."""
    while 0 < at < size:
        f.seek(at - 1)
        piece = f.read(_BACK)
        for k, byte in enumerate(piece):
            if byte != 0x5C:
                return at + k
        at += len(piece)
    return min(at, size)


def _structure(data: bytes, quoted: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places of brackets and commas outside of strings, their bytes and the depths behind them; whether a string is open at the end."""
    if b"\\" in data:
        data = re.sub(rb"\\.", b"  ", data, flags=re.S)
    buf = np.frombuffer(data, np.uint8)
    # Only the lowest bit counts, which a sum in a byte keeps.
    inside = (np.cumsum(buf == 0x22, dtype=np.uint8) + np.uint8(quoted)) & 1
    kind = _KIND[buf]
    at = np.flatnonzero((kind != 0) & (inside == 0))
    step = kind[at]
    return at, buf[at], depth + np.cumsum(np.where(step == 2, 0, step), dtype=np.int64), bool(inside[-1]) if len(inside) else quoted


def _key(f, at: int) -> str:
    """The key before the array that opens at ``at``."""
    back = _BACK
    while True:
        begin = max(0, at - back)
        f.seek(begin)
        # Where the text begins within an escape, the key's own quote is farther back.
        found = _KEY.search(f.read(at - begin))
        if found and (begin == 0 or found.start() > 1):
            return json.loads(b'"' + found.group(1) + b'"')
        if begin == 0:
            return ""
        back *= 4


def _elements(f, begin: int, end: int, size: int, quoted: bool, depth: int) -> Iterator[tuple[str | None, bytes]]:
    """Elements of arrays directly in the file's object that begin in a range: (key, text).

    An element begins at the bracket or comma before it. The key is null where
    the array is open at the range's beginning; an array that opens in the
    range, or an object in an array's place, is told by an element of its own without text.
    """
    f.seek(begin)
    own, more = end - begin, _AHEAD
    data = f.read(own + more)
    while True:
        at, byte, deep, _ = _structure(data, quoted, depth)
        opens, closes = np.isin(byte, (0x5B, 0x7B)), np.isin(byte, (0x5D, 0x7D))
        # What parts elements: an array's own brackets, and commas directly in it.
        some = np.flatnonzero((opens & (deep == 2)) | (closes & (deep == 1)) | ((byte == 0x2C) & (deep == 2)))
        mine = some[at[some] < own]
        # The last element that begins here ends with the mark behind it.
        if len(mine) == 0 or closes[mine[-1]] or len(mine) < len(some) or not (rest := f.read(more)):
            break
        data, more = data + rest, more * 2
    marks = at[some].tolist()
    bytes_ = byte[some].tolist()
    listed, key = depth >= 2, None
    for k, (place, mark) in enumerate(zip(marks, bytes_, strict=True)):
        if place >= own:
            return
        if mark == 0x5D or mark == 0x7D:
            listed = False
            continue
        if mark == 0x7B:
            listed, key = False, ""
            yield key, b""
            continue
        if mark == 0x5B:
            listed, key = True, _key(f, begin + place)
            yield key, b""
        if listed and k + 1 < len(marks):
            text = data[place + 1 : marks[k + 1]].strip()
            if text:
                yield key, text


def _ranged(spark: SparkSession, path: str, size: int, width: int, schema: str, run: Callable) -> DataFrame:
    """``run(file, number, begin, end, size)`` for every range, each in a task."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"]:
                store, inner, _ = located(path)
                with store.open_input_file(inner) as f:
                    begin, end = _edge(f, i * width, size), _edge(f, (i + 1) * width, size)
                    yield from run(f, int(i), begin, max(begin, end), size)

    n = max(1, -(-size // width))
    return spark.range(0, n, 1, n).mapInPandas(task, schema)


def array_elements(spark: SparkSession, path: str, width: int = RANGE) -> DataFrame:
    """``(listed, position, value)``: every element, as JSON text, of the arrays that stand directly in a file's object, by key and place.

    ``path`` is one file. Where the object has a key twice, both arrays come.
    """
    store, inner, _ = located(path)
    info = store.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    size = info.size

    def measured(f, i, begin, end, size):
        f.seek(begin)
        data = f.read(end - begin)
        found = [_structure(data, quoted, 0) for quoted in (False, True)]
        ends = [int(deep[-1]) if len(deep) else 0 for _, _, deep, _ in found]
        yield pd.DataFrame([(i, *ends, found[0][3])], columns=["i", "out", "in_", "turned"])

    # The driver holds a row for each range, and no element.
    starts, quoted, depth = [], False, 0
    for r in sorted(_ranged(spark, path, size, width, "i long, out long, in_ long, turned boolean", measured).collect()):
        starts.append((quoted, depth))
        depth += r["in_"] if quoted else r["out"]
        quoted ^= r["turned"]

    def counted(f, i, begin, end, size):
        runs: list[list] = [[None, 0]]
        for key, text in _elements(f, begin, end, size, *starts[i]):
            if text:
                runs[-1][1] += 1
            else:
                runs.append([key, 0])
        yield pd.DataFrame([(i, k, n) for k, n in (runs[0], runs[-1])], columns=["i", "key", "n"])

    entered, key, place, last = [], "", 0, {}
    for r in _ranged(spark, path, size, width, "i long, key string, n long", counted).collect():
        last.setdefault(r["i"], []).append((r["key"], r["n"]))
    for i in range(len(starts)):
        entered.append((key, place))
        (_, carried), (now, n) = last[i]
        # The same array goes on where none has opened in the range.
        key, place = (key, place + carried) if now is None else (now, n)

    def handed(f, i, begin, end, size):
        (key, place), rows = entered[i], []
        for now, text in _elements(f, begin, end, size, *starts[i]):
            if not text:
                key, place = now, 0
                continue
            # An object that is open at the range's beginning is no array.
            if key:
                rows.append((key, place, text.decode("utf-8", "replace")))
                place += 1
            if len(rows) >= _ROWS:
                yield pd.DataFrame(rows, columns=["listed", "position", "value"])
                rows = []
        yield pd.DataFrame(rows, columns=["listed", "position", "value"])

    return _ranged(spark, path, size, width, "listed string, position int, value string", handed)
