"""Hard negatives by norm-bucketed search.

Candidates are sorted by norm and cut into slabs, of which each is a part of
a written table, and in a task into buckets. By Cauchy-Schwarz no row of a
bucket scores more than the anchor's norm times the bucket's largest one. A
slab is sent only the anchors for which that bound reaches the lower limit of
one of their windows, and inside a task a bucket is passed over for the same reason, where
the limit rises to the running k-th score of the window. Anchors meet slabs
in blocks, so that a task holds one block and one slab.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stage
from .vectors import largest, matrix, quantised

#: Candidates of a slab, about, and of a bucket inside it.
SLAB_ROWS, BUCKET_ROWS = 16_384, 1024
#: Anchors that meet a slab in one task, about, and that are scored at a time.
BLOCK_ANCHORS, CHUNK_ANCHORS = 4096, 256
#: Share by which a bound on a score is raised, far more than rounding takes.
MARGIN = 1e-9

_FOUND = "a_id long, a_hash long, w int, c_id long, score long"
_ANCHOR = ("a_id", "a_hash")


def inner_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a @ c.T in whole numbers, exact; one that no long can hold raises an error."""
    most = a.shape[1] * largest(a) * largest(c)
    if most < 1 << 53:
        return (a.astype(float) @ c.astype(float).T).astype(np.int64)
    if most < 1 << 63:
        return a @ c.T
    raise OverflowError("a score may not fit into 64 bits")


@dataclass
class _Side:
    """Rows of one side of the search: ids (``gone`` where null), labels, vectors and norms."""

    ids: np.ndarray
    gone: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    norms: np.ndarray

    @staticmethod
    def of(t: pa.Table, name: str) -> _Side:
        ids = t.column(name).combine_chunks()
        x = matrix(t.column("x"))
        return _Side(
            ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), t.column("y").to_numpy(), x, np.sqrt((x.astype(float) ** 2).sum(axis=1)),
        )

    def take(self, at: np.ndarray) -> _Side:
        return _Side(self.ids[at], self.gone[at], self.labels[at], self.x[at], self.norms[at])


def _best(found: list[np.ndarray], side: _Side, k: int) -> np.ndarray:
    """Of rows (anchor, window, candidate, score): the first ``k`` of each window, score falling, then ids, null ids last."""
    met = np.concatenate(found, axis=1)
    at = met[2]
    met = met[:, np.lexsort((side.ids[at], side.gone[at], -met[3], met[1], met[0]))]
    group = met[0] * (met[1].max(initial=0) + 1) + met[1]
    first = np.r_[True, group[1:] != group[:-1]] if group.size else np.zeros(0, bool)
    rank = np.arange(group.size) - np.maximum.accumulate(np.where(first, np.arange(group.size), 0))
    return met[:, rank < k]


def search(anchors: _Side, lo: np.ndarray, hi: np.ndarray, rows: _Side, same: bool, k: int) -> np.ndarray:
    """For each anchor and window (lo, hi: anchors x windows): the first ``k`` rows with a score in it.

    ``same`` takes rows of the anchor's label with another id, otherwise those
    of other labels. Windows with lo > hi take nothing. Returns rows (anchor,
    window, row, score).
    """
    order = np.argsort(-rows.norms, kind="stable")
    rows_at = [order[i : i + BUCKET_ROWS] for i in range(0, len(order), BUCKET_ROWS)]
    buckets = [rows.take(at) for at in rows_at]
    out = [np.zeros((4, 0), np.int64)]
    for begin in range(0, len(anchors.ids), CHUNK_ANCHORS):
        some = np.arange(begin, min(begin + CHUNK_ANCHORS, len(anchors.ids)))
        need, most = lo[some].copy(), hi[some]
        kept = np.zeros((4, 0), np.int64)
        for at, bucket in zip(rows_at, buckets, strict=True):
            bound = anchors.norms[some] * bucket.norms[0] * (1 + MARGIN)
            alive = (need <= bound[:, None]) & (need <= most)
            if not (live := alive.any(axis=1).nonzero()[0]).size:
                continue
            a = anchors.take(some[live])
            scores = inner_products(a.x, bucket.x)
            low = np.where(alive[live], need[live], np.iinfo(np.int64).max).min(axis=1)
            fits = (scores >= low[:, None]) & ((a.labels[:, None] == bucket.labels) == same)
            if same:
                fits &= (a.ids[:, None] != bucket.ids) | (a.gone[:, None] != bucket.gone)
            i, j = fits.nonzero()
            s = scores[i, j]
            found = [kept]
            for w in range(need.shape[1]):
                inside = (s >= need[live[i], w]) & (s <= most[live[i], w])
                found.append(np.stack((live[i[inside]], np.full(int(inside.sum()), w), at[j[inside]], s[inside])))
            kept = _best(found, rows, k)
            # A full window's last score is what others must reach.
            last = np.arange(kept.shape[1])[k - 1 :]
            full = last[(kept[0, last] == kept[0, last - k + 1]) & (kept[1, last] == kept[1, last - k + 1])]
            need[kept[0, full], kept[1, full]] = np.maximum(need[kept[0, full], kept[1, full]], kept[3, full])
        kept[0] += begin
        out.append(kept)
    return np.concatenate(out, axis=1)


def _reached(anchors: DataFrame, slabs: list[tuple[int, float]]) -> DataFrame:
    """Anchors with the ``slab`` of every slab whose largest norm lets a score reach ``least``, the lowest of their limits."""
    ids = np.array([s for s, _ in slabs], np.int32)
    # Norms fall from slab to slab, but ties may lie in two.
    tops = np.maximum.accumulate(np.array([t for _, t in slabs])[::-1])

    @F.pandas_udf("array<int>")
    def reach(norm: pd.Series, least: pd.Series) -> pd.Series:
        need = np.where(norm > 0, least / np.where(norm > 0, norm, 1.0) / (1 + MARGIN), np.where(least > 0, np.inf, -np.inf))
        many = len(tops) - np.searchsorted(tops, need, side="left")
        return pd.Series([ids[:n] for n in many])

    return anchors.withColumn("slab", F.explode(reach(F.col("norm"), F.col("least").cast("double"))))


def _meet(anchors: DataFrame, rows: DataFrame, same: bool, k: int) -> DataFrame:
    """Search of anchors (with slab, block, los, his) among the rows of their slabs; the first ``k`` of each window and slab."""
    wanted = anchors.select(F.col("slab").alias("slab"), F.col("block").alias("block")).distinct()

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        a, c = _Side.of(left, "a_id"), _Side.of(right, "vec_id")
        found = np.zeros((4, 0), np.int64)
        if len(a.ids) and len(c.ids):
            found = search(a, matrix(left.column("los")), matrix(left.column("his")), c, same, k)
        who, w, at, s = found
        return pa.table({
            "a_id": left.column("a_id").take(pa.array(who)), "a_hash": left.column("a_hash").take(pa.array(who)),
            "w": pa.array(w, pa.int32()), "c_id": right.column("vec_id").take(pa.array(at)), "score": pa.array(s, pa.int64()),
        })

    left = anchors.select("slab", "block", *_ANCHOR, "y", "x", "los", "his").groupBy("slab", "block")
    right = rows.join(wanted, "slab").select("slab", "block", "vec_id", "y", "x").groupBy("slab", "block")
    return left.cogroup(right).applyInArrow(task, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """Of what the slabs have found: the first ``k`` of each window, with ``rank`` from 1."""
    order = Window.partitionBy(*_ANCHOR, "w").orderBy(F.desc("score"), F.asc_nulls_last("c_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """Hard negatives for ``rows`` (vec_id, y, x): for each anchor and each of its positives.

    ``x`` are equally long vectors of longs, ``y`` labels as longs; none of
    both is null. A row's score is its inner product with the anchor; higher
    scores come first, ties by id, null ids last. The positives are the first
    rows of the anchor's label with another id, the negatives of a positive
    the first rows of other labels that score from ``least`` per cent of its
    score up to its score; a positive that scores below zero has none. Rows
    that are repeated are rows of their own, but an anchor that is repeated
    counts once. An anchor without positives, or a positive without
    negatives, gives no row, as does an empty table.
    """
    big = np.iinfo(np.int64)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    rows = rows.select("vec_id", F.col("y").cast("long").alias("y"), "x", norm.alias("norm"))
    count = rows.count()
    slabbed = rows.repartitionByRange(max(1, -(-count // SLAB_ROWS)), F.desc("norm"), "vec_id").withColumn("slab", F.spark_partition_id())
    slabbed = stage(slabbed, "negatives-slabs")
    # A pair of numbers for each slab of SLAB_ROWS rows.
    slabs = [(r["slab"], r["top"]) for r in slabbed.groupBy("slab").agg(F.max("norm").alias("top")).orderBy("slab").collect()]
    anchors = slabbed.where(is_anchor).select(F.col("vec_id").alias("a_id"), F.xxhash64("vec_id", "y", "x").alias("a_hash"), "y", "x", "norm")
    anchors = anchors.dropDuplicates(list(_ANCHOR))
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    anchors = stage(anchors.withColumn("block", F.pmod("a_hash", F.lit(blocks)).cast("int")), "negatives-anchors")

    def lit(value: int) -> Column:
        return F.lit(int(value)).cast("long")

    # The slab of the largest norms alone bounds the last positive's score from below; the others are asked only for what can beat it.
    open_ = anchors.withColumns({"los": F.array(lit(big.min)), "his": F.array(lit(big.max)), "least": lit(big.min)})
    seeds = stage(_first(_meet(_reached(open_, slabs[:1]), slabbed, True, positives), positives), "negatives-seeds")
    if len(slabs) > 1:
        bound = seeds.where(F.col("rank") == positives).select(*_ANCHOR, F.col("score").alias("kth"))
        rest = open_.join(bound, list(_ANCHOR), "left").withColumn("least", F.coalesce("kth", "least")).withColumn("los", F.array("least"))
        more = _meet(_reached(rest, slabs[1:]), slabbed, True, positives)
        found = stage(_first(seeds.drop("rank").unionByName(more), positives), "negatives-positives")
        release(seeds)
    else:
        found = seeds

    low = F.expr(f"(score * {least} + 99) div 100")
    windows = found.where("score >= 0").select(*_ANCHOR, F.struct("rank", low.alias("lo"), F.col("score").alias("hi"), F.col("c_id").alias("id")).alias("p"))
    windows = windows.groupBy(*_ANCHOR).agg(F.array_sort(F.collect_list("p")).alias("p"))
    # Every anchor gets as many windows; those it lacks take nothing.
    limits = {
        "los": F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(F.col("p.lo"), i), lit(big.max))),
        "his": F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(F.col("p.hi"), i), lit(big.min))),
        "least": F.array_min("p.lo"),
    }
    windowed = stage(anchors.join(windows, list(_ANCHOR)).withColumns(limits), "negatives-windows")
    hard = _first(_meet(_reached(windowed, slabs), slabbed, False, negatives), negatives)
    p = F.get(F.col("p"), F.col("w"))
    return hard.join(windowed.select(*_ANCHOR, "p"), list(_ANCHOR)).select(
        F.col("a_id").alias("anchor_id"), p["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("c_id").alias("negative_id"),
        p["hi"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings`` (vec_id, embedding, label): anchors are the rows whose vec_id is divisible by 100.

    Rows with a null label, a null vector, or a null or non-finite component
    take no part; where vec_id is divisible by 7, label first becomes (label
    + 1) % 10. Vectors count as the floors of 256 times their components, a
    shorter one as filled up with zeros. Null ids are no anchors, but take
    part as others. Otherwise as ``mine``; columns may have other names beside these.
    """
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(embeddings.where("label IS NOT NULL"), "vec_id", "label").select("vec_id", moved.alias("y"), "x")
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), met AS (
  SELECT a.vec_id AS a, a.y = c.y AS same, c.vec_id AS c, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS s
  FROM q a JOIN q c ON a.vec_id IS DISTINCT FROM c.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT a, c, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, c NULLS LAST) AS p FROM met WHERE same QUALIFY p <= 5
)
SELECT p.a AS anchor_id, p.c AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.s DESC, n.c NULLS LAST) AS INTEGER) AS rank,
       n.c AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN met n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
QUALIFY rank <= 5
"""
