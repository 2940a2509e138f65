"""Quality classifier on random-indexing word vectors.

Words are hashed into buckets. Every bucket has a sparse random index vector,
and its word vector is the sum of the index vectors of its neighbours over
the whole corpus. Pooled word vectors of a document go through a two-layer
network with a temperature-calibrated output.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sample_share

#: Labelled documents the network is fitted on, about.
TRAIN_DOCS = 20_000
#: Word buckets; all of them fit one uint16 sort, and the vectors one small broadcast.
BUCKETS = 1 << 14
WIDTH = 32
#: Entries of an index vector that are not 0.
NONZERO = 4
REACH = 2
HIDDEN = 32
EPOCHS = 300
SEED = 20
THRESHOLD = 0.3
#: Tokens whose vectors are in memory at once.
TOKENS_AT_ONCE = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
FEATURES = 3 * WIDTH + 2


class _Bucket(dict):
    """Bucket numbers by token, filled as tokens come up; emptied when grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        # Case counts: a word in capitals is another word.
        found = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
        return found


def token_buckets(text: str | None, buckets: _Bucket) -> np.ndarray:
    return np.array(list(map(buckets.__getitem__, _TOKEN.findall(text))) if text else [], np.uint16)


def index_vectors() -> np.ndarray:
    """A row of ternary numbers for each bucket, and a last one of zeros for text borders."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS + 1, WIDTH), np.int16)
    places = rng.random((BUCKETS, WIDTH)).argsort(axis=1)[:, :NONZERO]
    out[np.arange(BUCKETS)[:, None], places] = rng.choice(np.array([-1, 1], np.int16), (BUCKETS, NONZERO))
    return out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context sums of one partition, a row for each bucket that occurs."""
    index, buckets = index_vectors(), _Bucket()
    total, seen = np.zeros((BUCKETS, WIDTH), np.int64), np.zeros(BUCKETS, np.int64)
    border = np.full(REACH, BUCKETS, np.int32)

    def add(parts: list[np.ndarray]) -> None:
        ids = np.concatenate([border, *[x for p in parts for x in (p.astype(np.int32), border)]])
        for at in range(REACH, len(ids) - REACH, TOKENS_AT_ONCE):
            end = min(at + TOKENS_AT_ONCE, len(ids) - REACH)
            around = sum(index[ids[at + d : end + d]] for d in range(-REACH, REACH + 1) if d)
            mid = ids[at:end].astype(np.uint16)
            order = np.argsort(mid, kind="stable")
            sorted_ids = mid[order]
            starts = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
            rows = sorted_ids[starts]
            real = rows < BUCKETS
            total[rows[real]] += np.add.reduceat(around[order], starts, axis=0, dtype=np.int32)[real]
            seen[rows[real]] += np.diff(np.append(starts, len(order)))[real]

    for batch in batches:
        parts, n = [], 0
        for text in batch.column(0).to_pylist():
            parts.append(token_buckets(text, buckets))
            n += len(parts[-1])
            if n >= TOKENS_AT_ONCE:
                add(parts)
                parts, n = [], 0
        if parts:
            add(parts)
    rows = np.flatnonzero(seen)
    if len(rows):
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(seen[rows]), *[pa.array(np.ascontiguousarray(total[rows, i])) for i in range(WIDTH)]],
            names=["bucket", "seen", *[f"v{i}" for i in range(WIDTH)]],
        )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Centred unit vectors of all buckets, from every text of the corpus. Sums are of whole numbers, so exact."""
    names = ["seen", *[f"v{i}" for i in range(WIDTH)]]
    sums = docs.select("text").mapInArrow(_summed, ", ".join(f"{c} long" for c in ["bucket", *names]))
    got = sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((BUCKETS, WIDTH))
    if got.num_rows:
        seen = got["seen"].to_numpy()[:, None]
        out[got["bucket"].to_numpy()] = np.column_stack([got[c].to_numpy() for c in names[1:]]) / np.sqrt(seen)
        common = out.sum(axis=0) / max(1, got.num_rows)
        out[got["bucket"].to_numpy()] -= common
    return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread over all tokens, mean over different ones, log of the length and share of different tokens."""
    out = np.zeros(FEATURES, np.float32)
    if len(ids):
        # By bucket counts, so a long text costs no more memory than the vectors do.
        counts = np.bincount(ids, minlength=1)
        kinds = np.flatnonzero(counts)
        v, w = vectors[kinds], (counts[kinds] / len(ids)).astype(np.float32)
        mean = w @ v
        out[:WIDTH] = mean
        out[WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(0, w @ (v * v) - mean * mean))
        out[2 * WIDTH : 3 * WIDTH] = v.mean(axis=0)
        out[-2:] = np.log1p(len(ids)) / 8, len(kinds) / len(ids)
    return out


@dataclass(frozen=True)
class Network:
    """Two layers over standardised features; the logit is divided by ``temperature``."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, features: np.ndarray) -> np.ndarray:
        h = np.tanh((features - self.mean) / self.spread @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((h @ self.w2 + self.b2) / self.temperature, -30, 30)))


def fit(features: np.ndarray, y: np.ndarray, calibrating: np.ndarray) -> Network:
    """Train by Adam on the rows not ``calibrating``, then set the temperature on those."""
    rng = np.random.default_rng(SEED)
    if not len(y) or y.min() == y.max():
        constant = float(y[0]) if len(y) else 0.5
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 60 * (constant - 0.5), 1.0)
    train = ~calibrating if (~calibrating).any() and np.ptp(y[~calibrating]) else np.ones(len(y), bool)
    mean, spread = features[train].mean(axis=0), features[train].std(axis=0) + 1e-4
    x, t = (features[train] - mean) / spread, y[train].astype(float)
    p = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(x @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(t)
        back = d[:, None] * p[2] * (1 - h * h)
        grads = [x.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
        for a, g, b, c in zip(p, grads, m, s, strict=True):
            b += 0.1 * (g - b)
            c += 0.001 * (g * g - c)
            a -= 0.02 * (b / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
    held = calibrating if calibrating.any() else train
    logits = np.tanh((features[held] - mean) / spread @ p[0] + p[1]) @ p[2] + p[3]
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logits / k).mean() for k in grid]
    return Network(mean, spread, p[0], p[1], p[2], float(p[3][0]), float(grid[int(np.argmin(loss))]))


def learn(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, train_docs: int = TRAIN_DOCS) -> Network:
    """Fit the network on about ``train_docs`` labelled documents outside the held-out fold, drawn by hash.

    A document labelled twice takes the smaller label. One fifth of the
    sample sets the temperature.
    """
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id"), 5) != 0)
    n = usable.count()
    drawn = sample_share(F.col("doc_id"), train_docs / max(1, n), 2)
    marked = usable.where(drawn).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = docs.select("doc_id", "text").where(fold(F.col("doc_id"), 5) != 0).where(drawn).join(marked, "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Bucket()
        for batch in batches:
            rows = [pooled(token_buckets(t, buckets), sent.value) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["doc_id", "quality", "features"],
            )

    got = sample.select("doc_id", "quality", "text").mapInArrow(features, "doc_id long, quality int, features binary")
    got = got.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) == 0).toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], r["features"]))
    x = np.array([np.frombuffer(r["features"], np.float32) for r in got], np.float64).reshape(len(got), FEATURES)
    return fit(x, np.array([r["quality"] for r in got]), np.array([r["held"] for r in got], bool))


def score_documents(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted (score of 0.3 or more), n_tokens.

    Only the text is looked at. A null text counts as empty, which is scored
    like any other text; null ids stay null; repeated rows give equal rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Bucket()
        v, net = sent.value
        for batch in batches:
            ids = [token_buckets(t, buckets) for t in batch.column(2).to_pylist()]
            x = np.array([pooled(i, v) for i in ids], np.float64).reshape(len(ids), FEATURES)
            share = net.score(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), batch.column(1), pa.array(share, pa.float64()),
                    pa.array((share >= THRESHOLD).astype(np.int32)), pa.array([len(i) for i in ids], pa.int64()),
                ],
                names=["doc_id", "held_out", "score", "predicted", "n_tokens"],
            )

    mine = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return mine.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int, n_tokens long")


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    vectors = word_vectors(docs)
    return score_documents(docs, vectors, learn(docs, labels, vectors))
