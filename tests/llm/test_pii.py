"""Personal data: base spans by the plain patterns, revealing terms by counting, and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time

import pytest

from graphloom.llm import pii, queries

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, text):
    digits = re.sub(r"\D", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        odd = [int(c) for c in digits[-1::-2]]
        even = [int(c) * 2 for c in digits[-2::-2]]
        return 12 <= len(digits) <= 19 and (sum(odd) + sum(x // 10 + x % 10 for x in even)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), list(PLAIN).index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if fits(k, m.group())]
    return sorted(found)


def noisy(rng, n):
    pieces = ["a@b.c", "@", "x.y", "+1 (555) 123-4567", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8.9", ".", "-", " ", "  ",
              "0", "12", "999999999999999999999", "(", ")", "é", "🙂", "\n", "_", "%", "user@host", "a@b..c", "a@b.c@d.e", "+49.30.1234567", "000.000.000.000", "0001.2.3.4"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    texts = noisy(rng, 20_000) + ["".join(rng.choice("a1@.+- ()%") for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("piece", ["a", "1", "1.", "@", "a@", "+1", "1 ", "+1.", "a@b.", "-", "\n", "a b "])
def test_long_texts_cost_in_proportion(piece):
    text = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    spans = pii.base_spans(text)
    list(pii.sentences_with(text, spans))
    assert time.perf_counter() - began < 20


def test_both_ways_cut_alike():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", ". ", ".", "\n", "!\n", "cd ", "é_", "9"]) for _ in range(rng.randint(0, 400)))
        assert [w for w, _ in pii.sentences_with(text, [])] == list(pii.sentences(text))


def by_counting(texts, threshold, least):
    """The terms to replace, each with True where its beginning may stay; every sentence counted one by one."""
    total, with_term, with_entity, both, different = 0, {}, {}, {}, {}
    for text in texts:
        spans = pii.base_spans(text or "")
        for words, entities in pii.sentences_with(text or "", spans):
            total += bool(words or entities)
            found = set()
            for w in words:
                w = w.lower()
                found |= {w} | ({w[:4] + "*"} if len(w) > 4 else set())
            for t in found:
                with_term[t] = with_term.get(t, 0) + 1
            for e in set(entities):
                with_entity[e] = with_entity.get(e, 0) + 1
                for t in found:
                    both[e, t] = both.get((e, t), 0) + 1
                    different.setdefault((e, t), set()).add(tuple(w.lower() for w in words))
    strong = set()
    for (e, t), n in both.items():
        if len(different[e, t]) >= least and with_entity[e] < total:
            share = math.log(n * total / (with_entity[e] * with_term[t])) / math.log(total / with_entity[e])
            if share >= threshold:
                strong.add((e, t))
    whole = {t for _, t in strong if not t.endswith("*")}
    return {t: len(t) > 4 and all((e, t[:4] + "*") not in strong for e, u in strong if u == t) for t in whole}


def told(rng):
    """Texts about few people, whose names come with their addresses; copies; other texts, some with the names alone."""
    common = ["the", "of", "was", "seen", "paris", "london", "yesterday", "report", "again", "zanzibar"]
    people = [("ann.lee@mail.example.com", "Annabella"), ("+1 (555) 123-4567", "zanzotto"), ("10.1.2.3", "Bo"), ("4111 1111 1111 1111", "quixotic")]
    out = []
    for _ in range(260):
        lines = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.choice(common) for _ in range(rng.randint(2, 9))]
            if rng.random() < 0.3:
                mail, name = rng.choice(people)
                words.insert(rng.randrange(len(words)), rng.choice([f"{name} {mail}", name.upper(), mail, f"{mail} and {name}"]))
            lines.append(" ".join(words))
        out.append(rng.choice([". ", "\n", "! "]).join(lines))
    return out + out[:40]


@pytest.mark.parametrize(("threshold", "least"), [(0.9, 2), (0.5, 2), (0.7, 4), (0.05, 1)])
def test_terms_by_counting(spark, threshold, least):
    texts = [*told(random.Random(3)), None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r["term"]: r["beginning"] for r in pii.learn(docs, threshold, least).collect()}
    want = by_counting(texts, threshold, least)
    assert want and set(got) == set(want)
    for t, stays in want.items():
        assert got[t] == (t[:4] + "…" if stays else None)


def test_spans_and_texts(spark):
    texts = [*told(random.Random(4)), None, "", "ANNABELLA, annabella\0 and Bo; ann.lee@mail.example.com"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = pii.learn(docs, 0.7)
    names = {r["term"]: r["beginning"] for r in listed.collect()}
    assert {"annabella", "bo"} <= set(names)
    rows = {r["doc_id"]: r for r in pii.personal_data(docs, listed).collect()}
    assert set(rows) == set(range(len(texts)))
    clean = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(docs, listed).collect()}
    for i, text in enumerate(texts):
        base = plain_spans(text or "")
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(j == n for _, j, _ in base) for n in range(4)]
        inside = {p for a, _, b in base for p in range(a, b)}
        terms = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W\d_]+", text or "") if m.group().lower() in names and m.start() not in inside]
        every = sorted(base + terms)
        assert rows[i]["spans"] == ",".join(f"{[*pii.KINDS, 'term'][k]}:{a}:{b}" for a, k, b in every)
        if text is None:
            assert clean[i] is None
        else:
            assert not plain_spans(clean[i]) and not {w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(r"\[\w+\]|\w+…", " ", clean[i]))} & set(names)
            if not every:
                assert clean[i] == text
    first = texts.index(next(t for t in texts if t and "@" in t))
    assert rows[first]["n_email"] and "[email]" in clean[first]


def test_odd_tables(spark):
    schema = "doc_id long, text string, term string, K1 long, added string, sanitised string, base int"
    assert pii.personal_data(spark.createDataFrame([], schema)).collect() == []
    assert pii.sanitise(spark.createDataFrame([], schema)).columns[-1] == "sanitised_"
    long_text = "a@b.example " + "word " * 200_000 + "10.0.0.1"
    rows = [(1, None), (None, "x 1.2.3.4"), (2, ""), (3, "a@b.c"), (3, "a@b.c"), (4, long_text), (5, "no data")]
    docs = spark.createDataFrame([(i, t, "t", 1, "a", "s", 2) for i, t in rows], schema)
    got = sorted(((r["doc_id"] or 0, r["spans"], r["n_email"], r["n_ip"]) for r in pii.personal_data(docs).collect()))
    assert got == [(0, "ip:2:9", 0, 1), (1, "", 0, 0), (2, "", 0, 0), (3, "email:0:5", 1, 0), (3, "email:0:5", 1, 0), (4, f"email:0:11,ip:{len(long_text) - 8}:{len(long_text)}", 1, 1), (5, "", 0, 0)]
    out = pii.sanitise(docs)
    assert out.columns == [*docs.columns, "sanitised_"]
    assert sorted(r["sanitised_"] or "" for r in out.collect())[:4] == ["", "", "[email]", "[email]"]


def test_the_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op11_pii(spark, SF).collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        base = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(text or "")]
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in rows[i]["spans"].split(",") if s and not s.startswith("term:")] == base
