"""Whitening and hard negatives against brute force, and on odd tables."""

from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pytest

from graphloom.llm import hard_negatives, queries, whitening

SF = "/root/testdata/sf0.01"


def frame(spark, rows, extra=False):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], y) for i, v, y in rows]
    if extra:
        rows = [(*r, "x", 1, 2.0) for r in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int" + (", x string, slab int, Norm double" if extra else ""))


def scaled(rows):
    width = max((len(v) for _, v, _ in rows), default=0)
    return [(i, np.array([np.floor(256 * c) for c in v] + [0] * (width - len(v)), object).astype(object), y) for i, v, y in rows]


@pytest.mark.parametrize(("shape", "rank"), [((40, 7), 7), ((5, 9), 5), ((30, 6), 3), ((1, 4), 1), ((12, 2), 2)])
def test_rotations_orthogonalise(shape, rank):
    rng = np.random.default_rng(rank)
    r = rng.normal(size=(shape[0], rank)) @ rng.normal(size=(rank, shape[1])) if rank < min(shape) else rng.normal(size=shape)
    r = r * np.logspace(0, -6, shape[1])
    v, s = whitening.orthogonalise(r)
    np.testing.assert_allclose(v.T @ v, np.eye(shape[1]), atol=1e-13)
    assert (np.diff(s) <= 0).all()
    want = np.zeros(shape[1])
    want[: min(shape)] = np.linalg.svd(r, compute_uv=False)
    np.testing.assert_allclose(s, want, rtol=1e-9, atol=1e-13)
    turned = r @ v
    np.testing.assert_allclose(turned.T @ turned, np.diag(s * s), atol=1e-12 * s[0] ** 2)


def whiten_by_hand(rows, count):
    """Covariance of the different vectors in exact numbers, then its eigenvectors."""
    x = [(i, [int(c) for c in v]) for i, v, _ in scaled(rows)]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, v in x:
        d = [n * c - s for c, s in zip(v, sums, strict=True)]
        for k in range(count):
            w = np.array(d, float) / n @ vectors[:, -1 - k] / values[-1 - k] ** 0.5
            out.setdefault((i, k + 1), []).append((n, sum(c * c for c in d), w, values[-1 - k] / values.sum()))
    return out


def check_whitened(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    assert len(got) == sum(map(len, want.values()))
    signs = {}
    for r in got:
        n, deviation, w, explained = want[r["vec_id"], r["component"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation)
        if abs(w) > 1e-6:
            signs.setdefault(r["component"], np.sign(w * r["whitened"]))
        assert r["whitened"] == pytest.approx(signs.get(r["component"], 1) * w, abs=1e-7)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_whitening_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(i, list(rng.normal(size=6) * [3, 2, 1, 0.5, 0.2, 0.1]), 0) for i in range(90)]
    rows += [(200 + i, rows[3][1], 1) for i in range(60)] + [(None, rows[4][1], None), (7, rows[7][1], 0), (300, [0.5, -0.25], 2)]
    odd = [(400, None, 1), (401, [1.0, None, 1, 1, 1, 1], 1), (402, [float("nan")] * 6, 1), (403, [float("inf"), 0, 0, 0, 0, 0], 1)]
    got = whitening.whitened_table(frame(spark, rows + odd, extra=True).repartition(5)).collect()
    check_whitened(got, whiten_by_hand(rows, 4))


def test_whitening_of_the_table(spark):
    table = duckdb.connect().sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet'").fetchall()
    check_whitened(queries.op12_whitening(spark, SF).collect(), whiten_by_hand(table, 4))


def test_whitening_folds_many_factors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 4)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(6)
    rows = [(i, list(rng.normal(size=3)), 0) for i in range(120)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        got = whitening.whitened_table(frame(spark, rows), 2).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    check_whitened(got, whiten_by_hand(rows, 2))


def test_whitening_without_deviation(spark):
    assert whitening.whitened_table(frame(spark, [])).collect() == []
    assert whitening.whitened_table(frame(spark, [(1, [], 0), (2, [], 0)])).collect() == []
    assert whitening.whitened_table(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    # One direction only: one component.
    got = whitening.whitened_table(frame(spark, [(i, [float(i), 2.0 * i], 0) for i in range(5)])).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 5 and got[0]["explained"] == pytest.approx(1)


def test_exact_numbers_beyond_longs():
    x = np.array([[1 << 40, -(1 << 40)]])
    d = whitening.deviations(x, 1 << 30, [5, -7])
    assert [int(v) for v in d[0]] == [(1 << 70) - 5, -(1 << 70) + 7]
    with pytest.raises(OverflowError):
        whitening.squared_lengths(d)
    assert hard_negatives.inner_products(np.array([[1 << 30, 3]]), np.array([[1 << 30, 5]]))[0, 0] == (1 << 60) + 15
    with pytest.raises(OverflowError):
        hard_negatives.inner_products(np.array([[1 << 40, 3]]), np.array([[1 << 40, 5]]))


def mine_by_hand(rows):
    """All scores of every anchor, one by one."""
    kept = []
    for i, v, y in rows:
        if y is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        kept.append((i, v, (y + 1) % 10 if i is not None and i % 7 == 0 else y))
    kept = scaled(kept)
    last = float("inf")
    out = []
    for a in {(i, tuple(x), y) for i, x, y in kept if i is not None and i % 100 == 0}:
        met = sorted((-sum(int(p) * int(q) for p, q in zip(a[1], x, strict=True)), last if i is None else i, y) for i, x, y in kept if i != a[0])
        same, other = [m for m in met if m[2] == a[2]], [m for m in met if m[2] != a[2]]
        for s, p, _ in same[:5]:
            fits = [m for m in other if 80 * -s <= 100 * -m[0] <= 100 * -s]
            out += [(a[0], None if p == last else p, r + 1, None if m[1] == last else m[1], -s, -m[0]) for r, m in enumerate(fits[:5])]
    return sorted(out, key=str)


def mined(df):
    return sorted(map(tuple, hard_negatives.hard_negatives(df).collect()), key=str)


def vectors(rng, n, labels, same=0):
    """Short vectors of small whole numbers, so scores tie; of very different lengths; the last ``same`` are equal."""
    rows = [(i * 10, [rng.choice([1, 1, 2, 8]) * rng.randint(-2, 4) / 256 for _ in range(4)], rng.randrange(labels)) for i in range(n - same)]
    return rows + [(i * 10, [3 / 256, 2 / 256, 1 / 256, 0.0], rng.randrange(labels)) for i in range(n - same, n)]


@pytest.mark.parametrize("seed", range(3))
def test_negatives_by_hand(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "SLAB_ROWS", [50, 1 << 14, 20][seed])
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", [5, 100, 3][seed])
    monkeypatch.setattr(hard_negatives, "CHUNK_ANCHORS", 4)
    rows = vectors(random.Random(seed), 240, 3 + seed, same=[0, 80, 80][seed])
    assert mined(frame(spark, rows).repartition(4)) == mine_by_hand(rows)


def test_negatives_on_odd_tables(spark):
    assert mined(frame(spark, [])) == []
    rows = vectors(random.Random(9), 60, 2)
    rows += [rows[10], rows[0], (0, [0.1, 0.2, 0.3, 0.1], 1), (None, rows[5][1], 1), (None, rows[6][1], 0)]
    rows += [(900, None, 1), (1000, [1.0, None, 1, 1], 1), (1100, [float("nan")] * 4, 1), (1200, [1.0, 0, 0, float("-inf")], 1), (1300, [1.0] * 4, None), (1400, [0.5], 1)]
    want = mine_by_hand(rows)
    assert want and mined(frame(spark, rows, extra=True)) == want
    # An anchor alone with its label has no positives, one label alone no negatives.
    assert mined(frame(spark, [(100, [1.0], 1), (200, [1.0], 2)])) == []
    assert mined(frame(spark, [(i, [1.0], 1) for i in (100, 101, 102)])) == []


def test_negatives_against_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.sql(hard_negatives.ORACLE)
    got = queries.op13_hard_negatives(spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.df()[columns].itertuples(index=False, name=None))


def test_buckets_are_passed_over(monkeypatch):
    """Long rows first: once the windows are full, buckets of short rows are not scored."""
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 10)
    rng = np.random.default_rng(3)
    x = rng.integers(1, 9, size=(100, 4)) * np.repeat([100, 1], 50)[:, None]
    zeros = np.zeros(100, np.int64)
    side = hard_negatives._Side(np.arange(100), zeros.astype(bool), zeros, x, np.sqrt((x.astype(float) ** 2).sum(1)))
    scored = []
    plain = hard_negatives.inner_products
    monkeypatch.setattr(hard_negatives, "inner_products", lambda a, c: scored.append(len(c)) or plain(a, c))
    big = np.iinfo(np.int64)
    one = side.take(np.array([0]))
    found = hard_negatives.search(one, np.array([[big.min]]), np.array([[big.max]]), side, True, 5)
    s = sorted((-int(v), i) for i, v in enumerate(x @ x[0]) if i)
    assert [(-int(v), int(i)) for _, _, i, v in found.T] == s[:5]
    assert sum(scored) <= 50
