"""Toxicity by maximal scoring segments.

Token scores are log-odds between toxic and other labelled documents under a
Dirichlet prior. A linear-time scan finds all maximal scoring segments of a
text; each segment's score is turned into an expected number of chance
segments (an extreme-value law fitted on the other documents), and what the
significant segments add up to is calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sample_share, stage

#: Labelled documents the model is fitted on, about.
TRAIN_DOCS = 20_000
#: Lengths of the word beginnings that lend their score to rare words.
STEMS = (6, 5, 4)
#: Pseudo-documents of the Dirichlet prior, shared out as the terms are in the whole sample.
PRIOR = 50.0
#: Standard errors a term's log-odds must lie above 0, and by which its score is lowered.
Z_LEAST = 3.0
Z_LOWER = 1.0
#: Log-odds that a listed term has at least: weaker ones mark a kind of text, not a toxic passage.
ODDS_LEAST = 1.0
#: In a toxic passage one token in so many is a listed one; gives the score of all others.
SPACING = 20
#: Chance segments a text may have for one of its segments to count as significant.
E_LEAST = 0.05

#: The row that has the number of words in all; no word is like it.
TOTAL = "#"

_WORD = re.compile(r"[^\W\d_]+")

SCHEMA = (
    "doc_id long, held_out boolean, score double, predicted int, n_tokens long, "
    "passages array<struct<first_char:int,last_char:int,expected:double>>"
)


@dataclass(frozen=True)
class Model:
    """``terms`` scores words, or beginnings ending in ``*``; others get ``rest``."""

    terms: dict[str, float]
    rest: float
    decay: float
    scale: float
    slope: float
    offset: float


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def stems(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEMS if len(word) > n]


class _Scores(dict):
    """Scores by word, filled as words come up; emptied when it has grown large."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        found = self.terms.get(word, 0.0)
        if not found:
            found = next((s for x in stems(word) if (s := self.terms.get(x, 0.0))), 0.0)
        self[word] = found
        return found


def maximal_segments(scores: list[tuple[int, float]], rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in linear time.

    ``scores`` has the positive positions in order; every position between
    has ``rest`` (negative). Each candidate keeps the running sums before its
    first and after its last position, and the nearest candidate before it
    that starts lower. Looking for a lower start follows these links, so a
    candidate once passed over is never looked at again.
    """
    kept: list[tuple[int, int, float, float, int]] = []
    total, after = 0.0, 0
    for at, s in scores:
        total += rest * (at - after)
        after = at + 1
        first, left = at, total
        total += s
        j = len(kept) - 1
        while j >= 0 and kept[j][2] >= left:
            j = kept[j][4]
        # Joined with a lower start that also ends lower, and all between; then the next lower one may join.
        while j >= 0 and kept[j][3] < total:
            first, left, lower = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = lower
        kept.append((first, at, left, total, j))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in kept]


def expected_by_chance(score: float, n_tokens: int, model: Model) -> float:
    """Segments of at least this score that a clean text of this length has on average."""
    return model.scale * max(1, n_tokens) * math.exp(-model.decay * score)


def statistic(segments: list[tuple[int, int, float]], n_tokens: int, model: Model) -> float:
    """Summed surprise (minus log of the expected count) of the significant segments, else the best one's."""
    surprise = [-math.log(max(1e-300, expected_by_chance(s, n_tokens, model))) for _, _, s in segments]
    significant = [x for x in surprise if x >= -math.log(E_LEAST)]
    if significant:
        return sum(significant)
    return max([*surprise, -math.log(max(1e-300, expected_by_chance(0.0, n_tokens, model)))])


def scan(text: str | None, model: Model, scores: _Scores) -> tuple[int, list[tuple[int, int, float]]]:
    """Token count and maximal segments of a whole text."""
    found = words(text)
    values = list(map(scores.__getitem__, found))
    hits = [(i, v) for i, v in enumerate(values) if v > 0.0]
    return len(found), maximal_segments(hits, model.rest) if hits else []


def probability(stat: float, model: Model) -> float:
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, model.slope * stat + model.offset))))


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            seen = set(words(text))
            counts[toxic].update(seen | {x for w in seen for x in stems(w)})
            counts[toxic][TOTAL] += len(seen)
        terms = list(counts[0] | counts[1])
        yield pd.DataFrame({"term": terms, "toxic_n": [counts[1][t] for t in terms], "other_n": [counts[0][t] for t in terms]})


def _sampled(docs: DataFrame, labels: DataFrame, train_docs: int) -> DataFrame:
    """A bounded sample of labelled documents outside the held-out fold: doc_id, text, toxic."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id"), 5) != 0)
    n = usable.count()
    if not n:
        return docs.select("doc_id", "text", F.lit(0).alias("toxic")).where("false")
    drawn = sample_share(F.col("doc_id"), train_docs / n, 1)
    marked = usable.where(drawn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Rows that repeat an id and text are one document.
    return docs.select("doc_id", "text").where(fold(F.col("doc_id"), 5) != 0).where(drawn).dropDuplicates().join(marked, "doc_id")


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit term scores, the extreme-value law and the calibration on a bounded labelled sample.

    Four fifths of the sample give the terms, the rest the calibration. A
    document labelled twice takes the larger label, and rows that repeat an id
    and text count once. Null ids, texts and labels teach nothing. Without
    labels of both kinds, as in empty tables, every score is 0.
    """
    sample = stage(_sampled(docs, labels, train_docs), "toxic-sample")
    fitting = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) != 0
    sizes = {(r["toxic"], r["fit"]): r["n"] for r in sample.groupBy("toxic", fitting.alias("fit")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get((1, True), 0), sizes.get((0, True), 0)
    empty = Model({}, math.log(1 - 1 / SPACING), 1.0, 1.0, 0.0, -60.0)
    if not n1 or not n0:
        return empty
    counts = (
        sample.where(fitting).select("text", "toxic")
        .mapInPandas(_count, "term string, toxic_n long, other_n long")
        .groupBy("term").agg(F.sum("toxic_n").alias("y1"), F.sum("other_n").alias("y0"))
    )
    counts = stage(counts.where(f"y1 >= 2 OR term = '{TOTAL}'"), "toxic-counts")
    total = counts.where(F.col("term") == TOTAL).first()
    alpha = F.lit(PRIOR) * (F.col("y1") + F.col("y0")) / F.lit(float(n1 + n0))
    # Against all words seen in such documents, so that longer documents favour no word.
    odds = lambda y, n: F.log((y + alpha) / F.lit(float(max(1, n))))
    delta = odds(F.col("y1"), total["y1"]) - odds(F.col("y0"), total["y0"])
    error = F.sqrt(1 / (F.col("y1") + alpha) + 1 / (F.col("y0") + alpha))
    scored = counts.where(F.col("term") != TOTAL).select("term", delta.alias("delta"), error.alias("error"))
    scored = scored.where(F.col("delta") > Z_LEAST * F.col("error")).where(F.col("delta") - Z_LOWER * F.col("error") >= ODDS_LEAST)
    # As many as pass; the sample bounds them.
    terms = {r["term"]: r["delta"] - Z_LOWER * r["error"] for r in scored.collect()}
    if not terms:
        return empty
    model = Model(terms, math.log(1 - 1 / SPACING), 1.0, 1.0, 0.0, 0.0)

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = _Scores(model.terms)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                n, segments = scan(text, model, scores)
                rows.append((n, max([0.0, *[s for _, _, s in segments]])))
            yield pd.DataFrame({"n": [r[0] for r in rows], "best": [r[1] for r in rows]})

    # Two numbers for each different document of the sample, in an order that does not depend on how rows are stored.
    clean = sample.where("toxic = 0").select("text").mapInPandas(measured, "n long, best double").toPandas().sort_values(["n", "best"])
    model = with_tail(model, clean["n"].to_numpy(float), clean["best"].to_numpy())

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = _Scores(model.terms)
        for frame in frames:
            found = [scan(text, model, scores) for text in frame["text"]]
            yield pd.DataFrame({"toxic": frame["toxic"], "fit": frame["fit"], "x": [statistic(segments, n, model) for n, segments in found]})

    held = sample.select("toxic", fitting.alias("fit"), "text").mapInPandas(summed, "toxic int, fit boolean, x double").toPandas()
    held = held.sort_values(["toxic", "x"])
    if held.loc[~held["fit"], "toxic"].nunique() == 2:
        held = held[~held["fit"]]
    slope, offset = _logistic(held["x"].to_numpy(), held["toxic"].to_numpy(float))
    return replace(model, slope=slope, offset=offset)


def with_tail(model: Model, n: np.ndarray, best: np.ndarray) -> Model:
    """The extreme-value law of clean texts' best segments: P(best < x) = exp(-K n e^(-decay x)). One decay for all; K follows from it."""
    n = np.maximum(1, n)
    decay = 1.0
    for _ in range(100):
        w = n * np.exp(-decay * best)
        gap = best.mean() - (w * best).sum() / w.sum()
        if gap <= 1e-9:
            break
        decay = min(1.0, 0.5 * decay + 0.5 / gap)
    return replace(model, decay=float(decay), scale=float(len(n) / (n * np.exp(-decay * best)).sum()))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """One-variable logistic regression with a light ridge, by Newton steps."""
    mean, spread = x.mean(), x.std() + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones_like(x)])
    ridge = np.diag([1e-2, 1e-6])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted, n_tokens and the significant passages.

    Passages are character spans with their expected number by chance.
    ``score`` looks at nothing but the text. A null text counts as empty and
    has the score of a text without findings; rows with a null id keep it.
    Texts of any length are scanned whole, in linear time. Repeated rows give
    equal rows, an empty table an empty one; other columns, whatever their
    names, are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scores = _Scores(m.terms)
        for batch in batches:
            share, sizes, passages = [], [], []
            for text in batch.column(2).to_pylist():
                n, segments = scan(text, m, scores)
                share.append(probability(statistic(segments, n, m), m))
                sizes.append(n)
                listed = [(a, b, e) for a, b, s in segments if (e := expected_by_chance(s, n, m)) <= E_LEAST]
                spans = [x.span() for x in _WORD.finditer(text.lower())] if listed else []
                passages.append([{"first_char": spans[a][0], "last_char": spans[b][1] - 1, "expected": e} for a, b, e in listed])
            kind = pa.list_(pa.struct([("first_char", pa.int32()), ("last_char", pa.int32()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), batch.column(1), pa.array(share, pa.float64()),
                    pa.array([int(s >= 0.5) for s in share], pa.int32()), pa.array(sizes, pa.int64()), pa.array(passages, kind),
                ],
                names=["doc_id", "held_out", "score", "predicted", "n_tokens", "passages"],
            )

    mine = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return mine.mapInArrow(scored, SCHEMA)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, learn(docs, labels))
