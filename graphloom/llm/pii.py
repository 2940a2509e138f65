"""Personal data by rules, and what gives it away by information theory.

Base spans (e-mail addresses, IP addresses, cards, phone numbers) are the
protected entities. The corpus tells how strongly a term reveals one:
sentences are counted that hold the entity, the term, and both, and the
disclosure of a term is its pointwise mutual information with the entity as a
share of the entity's own information. A term that exceeds the threshold is
replaced wherever it stands: by its beginning (a more general term), where
that stays within the threshold for all entities that the term reveals,
otherwise by nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage

#: Kinds in the order that decides between spans of one start; ``term`` is the method's own.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Share of an entity's information that a term may disclose.
THRESHOLD = 0.9
#: Different sentences that must hold an entity and a term together for the pair to count as evidence.
LEAST_SENTENCES = 2
#: Words and entities of a sentence; longer ones are cut, so work grows in proportion to a text.
SENTENCE_TOKENS = 64
#: Letters of a term's beginning, its generalisation.
BEGINNING = 4
#: Slots of the filter that thins out words before they are counted: two megabytes, whatever the corpus. Exact joins follow.
SLOTS = 1 << 24
#: The row that counts all sentences, and the entity's own sentences; no word is like it.
ALL = "#"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[.!?](?=\s)|\n")

_SPAN = "struct<start:int,kind:int,end:int>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match needs an ``@``: what stands before it back to the last match or other character, and a domain after it."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        first = at
        # Each stretch before an @ is looked at once.
        while first > done and not _NOT_LOCAL.match(text, first - 1):
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        at += 1
        done = at
        if domain:
            yield first, domain.end()
            at = done = domain.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Of a run of numbers with dots, four after four."""
    for run in _DOTTED.finditer(text):
        at, parts = run.start(), run.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _DIGITS.finditer(text):
        digits = run.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield run.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for run in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, run.group())) <= 15:
            yield run.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans in order, in code points; kinds as numbered in ``KINDS``."""
    found = []
    for kind, (mark, rule) in enumerate(zip(("@", ".", "", "+"), (_emails, _ips, _cards, _phones), strict=True)):
        if mark in text:
            found += [(a, kind, b) for a, b in rule(text)]
    return sorted(found)


def entity(text: str, kind: int, start: int, end: int) -> str:
    """What a span names: its kind, and its value without case, blanks and signs."""
    value = text[start:end]
    return f"{KINDS[kind]}:" + (value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value))


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with the spans' characters replaced, so that places stay."""
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            out += [text[at : max(a, at)], "\0" * (b - max(a, at))]
            at = b
    return "".join([*out, text[at:]])


def sentences(text: str) -> Iterator[list[str]]:
    """The words of each sentence of a text without spans, as they stand, at most ``SENTENCE_TOKENS`` at a time."""
    for part in _BREAK.split(text):
        found = _WORD.findall(part)
        for k in range(0, len(found), SENTENCE_TOKENS):
            yield found[k : k + SENTENCE_TOKENS]


def sentences_with(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[list[str], list[str]]]:
    """The words outside the spans and the entities of each sentence, as ``sentences`` cuts them; entities count as words there."""
    masked = _masked(text, spans)
    breaks = [m.end() for m in _BREAK.finditer(masked)] + [len(text) + 1]
    tokens = [(m.start(), False, m.group()) for m in _WORD.finditer(masked)] + [(a, True, entity(text, k, a, b)) for a, k, b in spans]
    held: list[tuple[int, bool, str]] = []
    k = 0
    for token in sorted(tokens):
        if token[0] >= breaks[k] or len(held) == SENTENCE_TOKENS:
            if held:
                yield [t for _, e, t in held if not e], [t for _, e, t in held if e]
            held = []
            while token[0] >= breaks[k]:
                k += 1
        held.append(token)
    if held:
        yield [t for _, e, t in held if not e], [t for _, e, t in held if e]


def beginning(word: str) -> str | None:
    """A term's generalisation; short terms have none."""
    return word[:BEGINNING] + "*" if len(word) > BEGINNING else None


def terms(words: list[str]) -> set[str]:
    """The lower-cased words of a sentence and their beginnings."""
    found = {w.lower() for w in words}
    return found | {w[:BEGINNING] + "*" for w in found if len(w) > BEGINNING}


def disclosure(both: int, with_entity: int, with_term: int, total: int) -> float:
    """Mutual information of entity and term as a share of the entity's information; 0 where the entity has none."""
    if with_entity >= total:
        return 0.0
    return float(np.log(both * total / (with_entity * with_term)) / np.log(total / with_entity))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"))


def _entity_sentences(docs: DataFrame) -> DataFrame:
    """``(entity, sentence, terms)`` for every entity of every sentence that holds one; ``sentence`` is a hash of its words."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                if spans := base_spans(text):
                    for words, entities in sentences_with(text, spans):
                        if entities:
                            key = int.from_bytes(hashlib.blake2b(" ".join(words).lower().encode(), digest_size=8).digest(), "big", signed=True)
                            found = sorted(terms(words))
                            rows += [(e, key, found) for e in sorted(set(entities))]
            yield pd.DataFrame(rows, columns=["entity", "sentence", "terms"])

    return _texts(docs).mapInPandas(find, "entity string, sentence long, terms array<string>")


class _Filter:
    """Says of a word whether it may be one of the terms in a table: a bit for each hash value, of a fixed number."""

    def __init__(self, table: DataFrame):
        slot = F.pmod(F.crc32("term"), F.lit(SLOTS))
        bits = table.select((slot / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, int(crc32(term) % {SLOTS} % 64))").alias("bit"))
        self.bits = np.zeros(SLOTS // 64, np.int64)
        # At most SLOTS / 64 rows.
        for r in bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
            self.bits[r["at"]] = r["bits"]

    def __call__(self, word: str) -> bool:
        slot = zlib.crc32(word.encode()) % SLOTS
        return bool(int(self.bits[slot >> 6]) >> (slot & 63) & 1)


class _Known(dict):
    """Terms of a word as it stands that pass a filter; emptied when it has grown large."""

    def __init__(self, keep: _Filter, beginnings: bool):
        super().__init__()
        self.keep, self.beginnings = keep, beginnings

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        lower = word.lower()
        wanted = (lower, beginning(lower)) if self.beginnings else (lower,)
        self[word] = found = tuple(w for w in wanted if w and self.keep(w))
        return found


def _counted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(term, n)``: sentences that hold each term of ``wanted``, and all sentences under ``ALL``; other terms may be among them."""
    keep = _Filter(wanted)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sums = _Known(keep, True), Counter()
        for batch in batches:
            for text in batch["text"]:
                spans = base_spans(text)
                for words in (w for w, _ in sentences_with(text, spans)) if spans else sentences(text):
                    sums[ALL] += 1
                    if found := {t for w in words if (k := known[w]) for t in k}:
                        sums.update(found)
            if len(sums) > 200_000:
                yield pd.DataFrame(sums.items(), columns=["term", "n"])
                sums.clear()
        yield pd.DataFrame(sums.items(), columns=["term", "n"])

    return _texts(docs).mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_SENTENCES) -> DataFrame:
    """``(term, beginning)`` of the terms to replace in ``docs`` (text): ``beginning`` is null where the term must go altogether.

    A pair of entity and term counts if at least ``least`` different sentences
    hold both; repeats of a sentence are counted in all numbers, but are no
    further evidence. Counts cover all documents. Null and empty texts hold
    nothing; an empty table, or one without entities, gives an empty one.
    """
    held = _entity_sentences(docs).groupBy("entity", "sentence").agg(F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms"))
    held = stage(held, "pii-sentences")
    spread = held.select("entity", "n", F.explode(F.concat(F.array(F.lit(ALL)), "terms")).alias("term"))
    pairs = spread.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sentences"))
    alone = pairs.where(F.col("term") == ALL).select("entity", F.col("n").alias("n_entity"))
    # A term stands in as many sentences at least as hold it beside some entity, and there are no more sentences than
    # characters: a pair that fails with these two numbers fails with the true ones, and its term need not be counted.
    seen = held.groupBy("sentence").agg(F.max("n").alias("n"), F.first("terms").alias("terms"))
    seen = seen.select("n", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("n").alias("n_seen"))
    characters = float(docs.agg(F.sum(F.length("text"))).first()[0] or 0) + 1
    possible = F.col("n_seen") <= F.col("n") * F.pow(F.lit(characters) / F.col("n_entity"), F.lit(max(0.0, 1 - threshold))) * (1 + 1e-9)
    pairs = pairs.where((F.col("term") != ALL) & (F.col("sentences") >= least)).select("entity", "term", "n")
    pairs = stage(pairs.join(alone, "entity").join(seen, "term").where(possible).select("entity", "term", "n", "n_entity"), "pii-pairs")
    counts = stage(_counted(docs, pairs.select("term").distinct()), "pii-counts")
    total = counts.where(F.col("term") == ALL).agg(F.max("n")).first()[0] or 0
    share = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term"))) / F.log(F.lit(float(total)) / F.col("n_entity"))
    strong = pairs.where(F.col("n_entity") < F.lit(total)).join(counts.select("term", F.col("n").alias("n_term")), "term")
    strong = stage(strong.where(share >= threshold).select("entity", "term"), "pii-strong")
    whole = strong.where(~F.col("term").endswith("*"))
    general = F.when(F.length("term") > BEGINNING, F.concat(F.substring("term", 1, BEGINNING), F.lit("*")))
    wide = strong.where(F.col("term").endswith("*")).select(F.col("entity").alias("e"), F.col("term").alias("g"))
    met = whole.withColumn("beginning", general).join(wide, (F.col("e") == F.col("entity")) & (F.col("g") == F.col("beginning")), "left")
    stays = F.bool_and(F.col("beginning").isNotNull() & F.col("g").isNull())
    found = met.groupBy("term").agg(F.when(stays, F.concat(F.substring("term", 1, BEGINNING), F.lit("…"))).alias("beginning"))
    return stage(found, "pii-terms")


def _term_spans(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``(k1, k2, added)``: by the hashes of a text, the places of listed terms in it, ``added`` with their replacements."""
    keep = _Filter(listed)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(keep, False)
        for batch in batches:
            rows = []
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                if not any(known[w] for w in set(_WORD.findall(text))):
                    continue
                spans = base_spans(text)
                for m in _WORD.finditer(_masked(text, spans) if spans else text):
                    rows += [(k1, k2, t, m.start(), m.end()) for t in known[m.group()]]
            yield pd.DataFrame(rows, columns=["k1", "k2", "term", "first", "last"])

    named = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    found = named.mapInPandas(find, "k1 long, k2 long, term string, first int, last int")
    place = F.struct(F.col("first").alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("last").alias("end"), "beginning")
    return found.join(listed, "term").groupBy("k1", "k2").agg(F.array_sort(F.collect_set(place)).alias("added"))


_BASE = f"n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{_SPAN}>"


def _base(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = base_spans(text)
        many = Counter(k for _, k, _ in spans)
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        rows.append([*(many[k] for k in range(len(KINDS))), hashlib.sha256(line.encode()).hexdigest(), [{"start": a, "kind": k, "end": b} for a, k, b in spans]])
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base"])


def personal_data(docs: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Every document's base spans and all its spans; ``listed`` are the terms of ``learn``, learnt from ``docs`` unless given.

    A null text counts as empty and has no spans. Repeated rows and null ids
    stay, equal texts have equal spans; work is in proportion to a text's
    length. An empty table gives an empty one. Only ``doc_id`` and ``text``
    are read, so other columns may have any name.
    """
    listed = learn(docs) if listed is None else listed
    base = F.pandas_udf(_base, _BASE)(F.coalesce("text", F.lit("")))
    named = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), base.alias("b"))
    met = named.join(_term_spans(docs, listed), ["k1", "k2"], "left")
    added = F.transform(F.coalesce("added", F.array()), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    kinds = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    every = F.transform(F.array_sort(F.concat("b.base", added)), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]))
    return met.select("doc_id", "b.n_email", "b.n_ip", "b.n_card", "b.n_phone", "b.base_sha256", F.concat_ws(",", every).alias("spans"))


def sanitise(docs: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``docs`` with a last column ``sanitised``: base spans replaced by their kind in brackets, listed terms by their beginnings or nothing.

    Null texts stay null; the new column gets another name where that one is taken. Otherwise as ``personal_data``.
    """
    listed = learn(docs) if listed is None else listed
    k1, k2, added = (fresh(docs.columns, c) for c in ("k1", "k2", "added"))
    places = _term_spans(docs, listed).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("added").alias(added))

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, terms, strict=True):
            if text is None:
                out.append(None)
                continue
            cuts = [(a, b, f"[{KINDS[k]}]") for a, k, b in base_spans(text)]
            cuts += [(s["start"], s["end"], s["beginning"] or "") for s in (found if found is not None else ())]
            parts, at = [], 0
            for a, b, put in sorted(cuts):
                # Where spans overlap, the first one's kind stands for all.
                if a >= at:
                    parts += [text[at:a], put]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    met = docs.withColumns({k1: F.xxhash64("text"), k2: F.xxhash64(F.lit(1), "text")}).join(places, [k1, k2], "left")
    return met.select(*[met[c] for c in docs.columns], rewrite("text", added).alias(fresh(docs.columns, "sanitised")))
