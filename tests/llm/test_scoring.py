"""Toxicity, quality and language ID: held-out accuracy, brute force and odd inputs."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, parsed string"


def odd_documents(spark):
    """Nulls, empty and very long texts, repeats, a clash of names."""
    rows = [
        (1, None, "en", None, None, None, None, None),
        (2, "", "en", "s", 0, 1.0, "x", "y"),
        (3, "the and of that idiot", "en", "s", 3, None, None, None),
        (3, "the and of that idiot", "en", "s", 3, None, None, None),
        (None, "der und die das", "de", "s", 3, None, None, None),
        (4, "the and of that " * 30_000, None, "s", 3, None, None, None),
        (5, "12 34 --", "en", "s", 3, None, None, None),
    ]
    return spark.createDataFrame(rows, ODD)


def accuracy(spark, made, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    got = [(r["predicted"], r[label], r["score"]) for r in made.where("held_out").join(labels, "doc_id").collect()]
    assert all(0 <= s <= 1 and (p == 1) for p, _, s in got if p) and len(got) > 50
    return sum(p == y for p, y, _ in got) / len(got)


def test_toxicity_held_out(spark):
    assert accuracy(spark, queries.op1_toxicity(spark, SF), "toxic") >= 0.9


def test_quality_held_out(spark):
    assert accuracy(spark, queries.op2_quality(spark, SF), "quality") >= 0.95


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_language_id(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.99


def test_odd_inputs(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(3, 1, 1), (3, 0, 0), (None, 1, 1), (4, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for made in (toxicity.toxicity_table(docs, labels), quality.quality_table(docs, labels)):
        rows = made.collect()
        assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({(r["score"]) for r in rows if r["doc_id"] == 3}) == 1
    langs = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_table(docs).collect()}
    assert langs[1] == langs[2] == langs[5] == ("und", 0.0)


def test_empty_tables(spark):
    docs, labels = odd_documents(spark).where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_table(docs, labels).collect() == []
    assert quality.quality_table(docs, labels).collect() == []
    assert langid.language_table(docs).collect() == []


def best_segments(values):
    """All maximal segments by their definition: every proper prefix and suffix is positive, and none contains another such."""
    n = len(values)
    good = []
    for i, j in itertools.combinations(range(n + 1), 2):
        part = values[i:j]
        if all(sum(part[:k]) > 1e-12 for k in range(1, len(part) + 1)) and all(sum(part[k:]) > 1e-12 for k in range(len(part))):
            good.append((i, j))
    return sorted((i, j - 1) for i, j in good if not any((a, b) != (i, j) and a <= i and j <= b for a, b in good))


def test_maximal_segments_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        values = [rng.choice([rng.uniform(0.5, 4), -0.7]) for _ in range(rng.randint(1, 12))]
        hits = [(i, v) for i, v in enumerate(values) if v > 0]
        got = toxicity.maximal_segments(hits, -0.7)
        assert [(a, b) for a, b, _ in got] == best_segments(values)
        assert all(math.isclose(s, sum(values[a : b + 1])) for a, b, s in got)


def test_segments_take_linear_time():
    """Operations, not seconds: list items looked at grow with the hits, also where every start is higher than those before it."""

    class Counted(list):
        looks = 0

        def __getitem__(self, i):
            Counted.looks += 1
            return super().__getitem__(i)

    def looks(hits, monkey):
        Counted.looks = 0
        source = monkey(toxicity.maximal_segments)
        source(hits, -0.05)
        return Counted.looks

    def counted(function):
        import inspect

        names = {"Counted": Counted}
        exec(inspect.getsource(function).replace("= []", "= Counted()").replace("list[tuple[int, int, float, float, int]]", "list"), names)
        return names["maximal_segments"]

    for spacing in (1, 20, 40, 100):
        few, many = ([(i * spacing, 1.0 + 0.01 * (i % 7)) for i in range(n)] for n in (2000, 4000))
        assert looks(many, counted) <= 2.2 * looks(few, counted) + 100


def test_log_odds_and_tail_by_definition(spark):
    """The model's scores and extreme-value law against plain sums over the sample."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels)
    sample = toxicity._sampled(docs, labels, toxicity.TRAIN_DOCS).selectExpr("text", "toxic", "pmod(xxhash64(doc_id, 5), 5) <> 0 AS fit").collect()
    seen = [(r["toxic"], set(toxicity.words(r["text"]))) for r in sample if r["fit"]]
    ends = {kind: sum(len(w) for k, w in seen if k == kind) for kind in (0, 1)}
    share = toxicity.PRIOR / len(seen)
    for term, score in list(model.terms.items())[:20]:
        y = {kind: sum(term in w | {x for v in w for x in toxicity.stems(v)} for k, w in seen if k == kind) for kind in (0, 1)}
        alpha = share * (y[0] + y[1])
        delta = math.log((y[1] + alpha) / ends[1]) - math.log((y[0] + alpha) / ends[0])
        assert math.isclose(score, delta - toxicity.Z_LOWER * math.sqrt(1 / (y[1] + alpha) + 1 / (y[0] + alpha)), rel_tol=1e-9)
    scores = toxicity._Scores(model.terms)
    scanned = [toxicity.scan(r["text"], model, scores) for r in sample if not r["toxic"]]
    best = np.array([max([0.0, *[s for _, _, s in found]]) for _, found in scanned])
    n = np.array([max(1, k) for k, _ in scanned], float)
    weight = n * np.exp(-model.decay * best)
    # Both conditions of the likelihood's maximum, or the bound of the decay.
    assert model.decay == 1.0 or math.isclose(1 / model.decay, best.mean() - (weight * best).sum() / weight.sum(), rel_tol=1e-3)
    assert math.isclose(model.scale, len(n) / weight.sum(), rel_tol=1e-6)


def test_passages_are_spans(spark):
    model = toxicity.Model({"idiot": 8.0, "moro*": 7.0}, -0.05, 1.0, 0.005, 0.5, -6.0)
    text = "Fine words here. You IDIOT, what a moronic thing. " + "calm " * 50
    row = toxicity.score_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [text[p["first_char"] : p["last_char"] + 1] for p in row["passages"]] == ["IDIOT, what a moronic"]


def parsed_phrases(text: str, reference: str) -> int:
    count = i = 0
    while i < len(text):
        n = 0
        while i + n < len(text) and text[i : i + n + 1] in reference:
            n += 1
        i += max(1, n)
        count += 1 if n else 2
    return count


def squeezed(text: str) -> str:
    return re.sub(r"[\W\d_]+", " ", text.lower())


@pytest.mark.parametrize("block", [4, 7, 512])
def test_phrases_by_brute_force(block, monkeypatch):
    """However the walk is cut into blocks, texts are parsed as one; letters of every kind take part."""
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(4)
    letters = "ab c日本語жщ" + "".join(map(chr, range(0x4E00, 0x4F00)))
    references = ["".join(rng.choice("ab c") for _ in range(60)), "".join(rng.choice(letters) for _ in range(900)), "a" * 50 + "ab" * 30]
    references = [langid.normalise(r) for r in references]
    model = langid.automata(tuple((f"l{i}", r) for i, r in enumerate(references)))
    texts = ["".join(rng.choice(rng.choice(["abcdx", letters])) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += ["a" * 120, "ab" * 70, references[1][100:400], "x", references[1][:9] * 20]
    got = langid.phrase_counts([model.alphabet.codes(t)[0] for t in texts], model)
    assert got.tolist() == [[parsed_phrases(squeezed(t), squeezed(r)) for r in references] for t in texts]


def test_many_languages_and_scripts(spark):
    """Seventy languages with letters of their own: none is left out."""
    rows = [(i, "".join(chr(0x4E00 + 40 * (i % 70) + (7 * j + j * j * (i // 70)) % 40) for j in range(200)), f"l{i % 70:02}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    named = dict(langid.language_table(docs).select("doc_id", "lang_pred").collect())
    assert all(named[i] == lang for i, _, lang in rows)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, quality.FEATURES))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    net = quality.fit(x, y, np.arange(600) % 5 == 0)
    assert ((net.score(x) >= 0.5) == y).mean() > 0.95 and net.temperature > 0


def test_pooling_whole_text():
    vectors = np.eye(quality.BUCKETS, quality.WIDTH, dtype=np.float32)
    buckets = quality._Bucket()
    long = quality.token_buckets("word other " * 50_000, buckets)
    assert len(long) == 100_000
    assert np.allclose(quality.pooled(long, vectors)[: quality.WIDTH], quality.pooled(long[:2], vectors)[: quality.WIDTH])
    assert quality.pooled(quality.token_buckets(None, buckets), vectors).sum() == 0


@pytest.mark.parametrize("text", [None, "", "1 2 3"])
def test_texts_without_words(text):
    assert toxicity.words(text) == []
