"""Embedding whitening by one-sided Jacobi SVD.

The fit list, every different vector once, is centred and compressed block by
block to upper triangular factors (TSQR): each partition folds its blocks
into one factor, factors are stacked and folded again, a bounded number at a
time. Plane rotations then make the columns of the last factor R orthogonal;
the rotations add up to the components, the columns' lengths are the standard
deviations times the root of the number of vectors. Nothing is squared before
it is orthogonal, so small deviations keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import largest, matrix, quantised

#: Rows that are folded into a factor at a time, and factors that meet in one task.
BLOCK_ROWS, FAN_IN = 4096, 32
#: Sweeps of rotations before giving up; ten are plenty for any matrix in double precision.
MAX_SWEEPS = 60

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Fit:
    """``n`` vectors with the sums ``sums``; unit components in columns, their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as longs, or as unbounded numbers where longs could overflow."""
    if n * largest(x) + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squared_lengths(d: np.ndarray) -> np.ndarray:
    """Sums of squares of whole numbers, exact; one that no long can hold raises an error."""
    if d.dtype != object and d.shape[1] * largest(d) ** 2 < 1 << 63:
        return (d * d).sum(axis=1)
    found = (d.astype(object) ** 2).sum(axis=1)
    if max(found, default=0) >= 1 << 63:
        raise OverflowError("a deviation does not fit into 64 bits")
    return found.astype(np.int64)


def orthogonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations ``v`` and lengths ``s``: the columns of r @ v are orthogonal and have the lengths s, falling.

    One-sided Jacobi: each round rotates disjoint pairs of columns at once
    (as in a tournament where all meet all), each pair by the angle that makes it
    orthogonal, until no pair is further from it than rounding is. Columns
    that are rounding errors beside the whole matrix count as zero.
    """
    d = r.shape[1]
    even = d + d % 2
    a = np.zeros((r.shape[0], even))
    a[:, :d] = r
    v = np.eye(even)
    seats = np.arange(even)
    eps = np.finfo(float).eps
    tiny, nothing = eps * max(1, len(r)) ** 0.5, (eps * np.linalg.norm(a)) ** 2
    for _ in range(MAX_SWEEPS):
        turned = False
        for _ in range(max(1, even - 1)):
            p, q = seats[: even // 2], seats[::-1][: even // 2]
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            open_ = (np.abs(gamma) > tiny * np.sqrt(alpha) * np.sqrt(beta)) & (np.minimum(alpha, beta) > nothing)
            if open_.any():
                turned = True
                zeta = (beta - alpha) / np.where(open_, 2 * gamma, 1.0)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = np.where(open_, 1 / np.hypot(1.0, t), 1.0)
                s = np.where(open_, c * t, 0.0)
                for m in (a, v):
                    left, right = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if not turned:
            break
    else:
        raise RuntimeError("the rotations did not settle")
    lengths = np.sqrt((a * a).sum(0))[:d]
    order = np.argsort(-lengths, kind="stable")
    return v[:d, :d][:, order], lengths[order]


def _factor(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """``(part, r)``: one factor for each partition that has rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = matrix(batch.column(0))
            for k in range(0, len(x), BLOCK_ROWS):
                block = deviations(x[k : k + BLOCK_ROWS], n, sums).astype(float) / n
                r = np.linalg.qr(block if r is None else np.vstack((r, block)), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "r": [r.ravel()]})

    return rows.select("x").mapInArrow(fold, "part int, r array<double>")


def _stacked(factors: list[np.ndarray], width: int) -> np.ndarray:
    return np.linalg.qr(np.vstack([f.reshape(-1, width) for f in factors]), mode="r")


def fit(rows: DataFrame, count: int) -> Fit | None:
    """Of ``rows`` (x), every different vector once: the first ``count`` components; None without any deviation."""
    n = rows.count()
    if not n:
        return None
    found = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("s")).collect()
    sums = [r["s"] for r in sorted(found, key=lambda r: r["at"])]
    width = len(sums)
    if not width:
        return None
    factors = stage(_factor(rows, n, sums), "whitening-factors")
    while (many := factors.count()) > FAN_IN:

        def fold(key: tuple, met: pa.Table) -> pa.Table:
            r = _stacked([np.asarray(f) for f in met.column("r").to_pylist()], width)
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

        order = factors.select(F.xxhash64("part").alias("h"), "part", "r")
        groups = F.pmod("h", F.lit(-(-many // (FAN_IN // 2)))).cast("int")
        factors = stage(order.groupBy(groups.alias("g")).applyInArrow(fold, "part int, r array<double>"), "whitening-factors")
    r = _stacked([np.array(f["r"]) for f in factors.orderBy("part").collect()], width)
    v, lengths = orthogonalise(r)
    rank = int((lengths > np.finfo(float).eps * max(r.shape) * lengths[0]).sum())
    if not rank:
        return None
    v, lengths = v[:, : min(count, rank)], lengths
    # Either sign is right; the largest entry is made positive.
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return Fit(n, sums, v, (lengths**2)[: v.shape[1]] / n, float((lengths**2).sum() / n))


def whiten(x: np.ndarray, model: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Exact squared lengths of n * x - sums, and the whitened coordinates."""
    d = deviations(x, model.n, model.sums)
    return squared_lengths(d), (d.astype(float) / model.n) @ model.components / np.sqrt(model.eigenvalues)


def identity_error(rows: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(model.eigenvalues)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = whiten(matrix(batch.column(0)), model)[1]
                total += w.T @ w
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(k * k), pa.int32()), "s": total.ravel()})

    sums = rows.select("x").mapInArrow(add, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    cov = np.zeros(k * k)
    for r in sums:
        cov[r["at"]] = r["s"] / model.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())


def whitened_table(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """Every row with a vector of finite entries, once for each of the first ``components``.

    Vectors count as the floors of 256 times their entries. Rows without a
    vector, or with a null or non-finite entry, go; null ids and repeated
    rows stay (a repeated vector counts once in the fit). A shorter vector
    counts as filled up with zeros. Components without any deviation
    beyond rounding cannot be whitened and are not returned, so the result is empty for
    an empty table and where all vectors are equal. Of equal eigenvalues any
    orthogonal components are right. A deviation that exceeds 64 bits is an error.
    Other columns may have any name.
    """
    rows = quantised(embeddings, "vec_id")
    distinct = stage(rows.select("x").distinct(), "whitening-fit")
    model = fit(distinct, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(distinct, model)
    k = len(model.eigenvalues)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                length, w = whiten(matrix(part.column(1)), model)
                m = len(length)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    "n": pa.array(np.full(m * k, model.n), pa.int64()),
                    "deviation": pa.array(np.repeat(length, k), pa.int64()),
                    "whitened": w.ravel(),
                    "explained": np.tile(model.eigenvalues / model.trace, m),
                    "identity_error": np.full(m * k, error),
                })

    return rows.select("vec_id", "x").mapInArrow(emit, SCHEMA)
