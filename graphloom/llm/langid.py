"""Language identification by cross-parsing entropy.

One suffix automaton per language, over a bounded sample of labelled text,
gives the longest match from any point of a text. A text is parsed greedily
into such matches; the language that needs the fewest phrases, each weighed
by the bits of a pointer into its sample, wins.

The automata's transitions lie in one packed table (a state's own offset plus
the character's number, checked by the state), so any number of characters
and languages takes part and a walk is a few array operations per character.
Long texts are walked in blocks side by side; then each block's first phrase
is carried over from the block before until both parses agree, which gives
the parse of the whole text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh

#: Characters of labelled text that each language's automaton is built on, at most.
SAMPLE_CHARS = 24_000
#: Labelled documents drawn for each language, about.
SAMPLE_DOCS = 60
#: Characters of a text that are walked side by side with others; of no effect on the result.
BLOCK = 512
#: Blocks that are walked together, about.
BLOCKS_AT_ONCE = 4096
#: Texts that are in memory as Python strings.
ROWS_AT_ONCE = 1000
UNKNOWN = "und"

_GRAIN = 1 << 30
#: Numbers of characters: what ends a block, what no sample has, what is no letter; letters follow.
_END, _NEW, _BLANK = 0, 1, 2


def normalise(text: str) -> str:
    """Lower case, with every run of non-letters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split(" "))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class _Alphabet:
    """Dense numbers for the characters of all samples."""

    def __init__(self, texts: list[str]):
        letters = sorted(set("".join(texts)) - {" "})
        self.size = len(letters) + 3
        self.table = np.where(_letters(), _NEW, _BLANK).astype(np.int32)
        self.table[[ord(c) for c in letters]] = np.arange(3, self.size)

    def codes(self, text: str) -> tuple[np.ndarray, bool]:
        """Numbers of the text's characters, each run of non-letters as one, and whether there is a letter."""
        out = self.table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != _BLANK) | (out[:-1] != _BLANK)
        out = out[keep]
        return out, bool((out != _BLANK).any())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``, one dictionary per state (state 0 is the root)."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


def _packed(step: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset of each state, and state and target of each slot: the transition by ``c`` is at offset + c if that slot has the state."""
    size = sum(map(len, step)) * 2 + 4 * width + 8192
    offset = np.zeros(len(step), np.int32)
    state, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    free = np.ones(size, bool)
    single = [s for s, t in enumerate(step) if len(t) == 1]
    low, window = 0, 1024
    for s in sorted((s for s, t in enumerate(step) if len(t) > 1), key=lambda s: -len(step[s])):
        chars = np.array(list(step[s]))
        at = low
        while True:
            if at + window + width > len(free):
                more = max(size, window + width)
                free = np.append(free, np.ones(more, bool))
                state, target = np.append(state, np.full(more, -1, np.int32)), np.append(target, np.zeros(more, np.int32))
            fits = free[at + chars[0] : at + chars[0] + window].copy()
            for c in chars[1:]:
                fits &= free[at + c : at + c + window]
            if fits.any():
                at += int(fits.argmax())
                break
            at += window
        # Where hardly anything is free nothing will fit either.
        if free[low : low + window].sum() < window // 16:
            low += window
        offset[s] = at
        free[at + chars] = False
        state[at + chars] = s
        target[at + chars] = list(step[s].values())
    chars = np.array([next(iter(step[s])) for s in single], np.int64)
    slots = np.flatnonzero(free[width:])[: len(single)] + width
    if len(slots) < len(single):
        more = np.arange(len(free), len(free) + len(single) - len(slots))
        slots = np.append(slots, more)
        state, target = np.append(state, np.full(len(more), -1, np.int32)), np.append(target, np.zeros(len(more), np.int32))
    offset[single] = slots - chars
    state[slots] = single
    target[slots] = [next(iter(step[s].values())) for s in single]
    used = int(np.flatnonzero(state >= 0).max(initial=-1)) + width + 1
    pad = max(0, used - len(state))
    return offset, np.append(state, np.full(pad, -1, np.int32))[:used], np.append(target, np.zeros(pad, np.int32))[:used]


@dataclass(frozen=True)
class Automata:
    """All languages' automata in one table; ``begin`` has each root's transitions by character."""

    names: list[str]
    alphabet: _Alphabet
    roots: np.ndarray
    offset: np.ndarray
    state: np.ndarray
    target: np.ndarray
    begin: np.ndarray
    bits: np.ndarray

    def walk(self, at: np.ndarray, root: np.ndarray, lang: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one character each, and how many phrases began with it."""
        slot = self.offset[at] + c
        goes = self.state[slot] == at
        now = np.where(goes, self.target[slot], self.begin[lang, c])
        # A character that a sample lacks leads back to the root and counts twice: as a phrase, and for not being there.
        return now, (~goes | (at == root)).astype(np.int8) + (now == root)


@lru_cache(maxsize=1)
def automata(samples: tuple[tuple[str, str], ...]) -> Automata:
    alphabet = _Alphabet([text for _, text in samples])
    parts, roots, begin = [], [], []
    at = slots = 0
    for _, text in samples:
        step = suffix_automaton(alphabet.codes(text)[0].tolist())
        offset, state, target = _packed(step, alphabet.size)
        first = np.full(alphabet.size, at, np.int32)
        for c, s in step[0].items():
            first[c] = at + s
        parts.append((offset + np.int32(slots), np.where(state >= 0, state + at, -1).astype(np.int32), target + np.int32(at)))
        roots.append(at)
        begin.append(first)
        at += len(offset)
        slots += len(state)
    offset, state, target = (np.concatenate(x) for x in zip(*parts, strict=True))
    bits = np.array([math.log2(len(text) + 2) for _, text in samples])
    return Automata([lang for lang, _ in samples], alphabet, np.array(roots, np.int32), offset, state, target, np.array(begin), bits)


def phrase_counts(texts: list[np.ndarray], model: Automata) -> np.ndarray:
    """Phrases of each text's greedy parse (rows) under each automaton (columns)."""
    langs = len(model.roots)
    blocks = [(i, t[at : at + BLOCK]) for i, t in enumerate(texts) for at in range(0, len(t), BLOCK)]
    if not blocks:
        return np.zeros((len(texts), langs), np.int64)
    owner = np.array([i for i, _ in blocks])
    lengths = np.array([len(b) for _, b in blocks])
    grid = np.full((len(blocks), BLOCK), _END, np.int32)
    for k, (_, b) in enumerate(blocks):
        grid[k, : len(b)] = b
    order = np.argsort(-lengths, kind="stable")
    columns = np.ascontiguousarray(grid[order].T)
    live = np.searchsorted(-lengths[order], -np.arange(BLOCK), side="left")
    root, lang = model.roots[:, None], np.arange(langs)[:, None]
    state = np.repeat(root, len(blocks), axis=1)
    counts = np.zeros((langs, len(blocks)), np.int64)
    for j in range(int(lengths.max())):
        n = int(live[j])
        state[:, :n], begun = model.walk(state[:, :n], root, lang, columns[j, :n])
        counts[:, :n] += begun
    back = np.argsort(order)
    leaves, counts = state[:, back], counts[:, back]

    # What a block has begun anew is set right from the block before: every block of a text but its first,
    # and again where that has changed how its predecessor is left.
    lang, block = np.nonzero(np.broadcast_to(np.append(False, owner[1:] == owner[:-1]), (langs, len(blocks))))
    change = np.zeros_like(counts)
    alone = leaves.copy()
    while len(block):
        own_root = model.roots[lang]
        true, anew = leaves[lang, block - 1].copy(), own_root.copy()
        change[lang, block] = 0
        open_ = np.flatnonzero(true != anew)
        for j in range(BLOCK):
            open_ = open_[lengths[block[open_]] > j]
            if not len(open_):
                break
            c, r, g = grid[block[open_], j], own_root[open_], lang[open_]
            true[open_], begun = model.walk(true[open_], r, g, c)
            anew[open_], begun_anew = model.walk(anew[open_], r, g, c)
            change[g, block[open_]] += begun.astype(np.int64) - begun_anew.astype(np.int64)
            # Equal states go on alike.
            open_ = open_[true[open_] != anew[open_]]
        left = np.where(true != anew, true, alone[lang, block])
        changed = np.flatnonzero(leaves[lang, block] != left)
        leaves[lang, block] = left
        follows = changed[block[changed] + 1 < len(blocks)]
        follows = follows[owner[block[follows] + 1] == owner[block[follows]]]
        lang, block = lang[follows], block[follows] + 1
    total = np.zeros((len(texts), langs), np.int64)
    np.add.at(total, owner, (counts + change).T)
    return total


def classify(texts: list[str | None], samples: tuple[tuple[str, str], ...]) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``und`` and 0 for texts without a letter."""
    if not samples:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    model = automata(samples)
    total = np.zeros((len(texts), len(model.names)), np.int64)
    letters = np.zeros(len(texts), bool)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if held:
            total[[i for i, _ in held]] = phrase_counts([codes for _, codes in held], model)
        held.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        codes, letters[i] = model.alphabet.codes(text)
        if letters[i]:
            held.append((i, codes))
            size += len(codes) // BLOCK + 1
            if size >= BLOCKS_AT_ONCE:
                flush()
                size = 0
    flush()
    cost = total * model.bits
    best = cost.argmin(axis=1)
    share = np.exp2(-np.minimum(60.0, cost - cost.min(axis=1, keepdims=True)))
    score = 1.0 / share.sum(axis=1)
    return (
        [model.names[b] if has else UNKNOWN for b, has in zip(best, letters, strict=True)],
        [float(s) if has else 0.0 for s, has in zip(score, letters, strict=True)],
    )


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """Labelled text of every language, bounded by ``sample_docs`` and ``sample_chars`` for each.

    Only rows with a text, a non-null lang and crc32(doc_id) mod 3 other than
    1 are used; rows that repeat an id and text count once, a null id has the
    fold of the empty text. Which rows, and which stretch of each, is decided
    by hash, so the result does not depend on how the table is stored. An
    empty table teaches no language.
    """
    labelled = docs.where(fold(F.col("doc_id"), 3) != 1).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return ()
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(min(1.0, sample_docs / n) * _GRAIN))])
    text_hash = F.xxhash64("text")
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", text_hash, F.lit(6)), F.lit(_GRAIN)) < F.element_at(limits, F.col("lang")))
    # No more of a text than the sample can hold, from a place that its hash names.
    start = F.pmod(text_hash, F.greatest(F.char_length("text") - sample_chars + 1, F.lit(1))) + 1
    stretch = F.substring("text", start.cast("int"), F.lit(sample_chars))
    by_lang: dict[str, list[tuple[str, str]]] = {}
    for r in drawn.select("lang", "doc_id", stretch.alias("text")).distinct().collect():
        by_lang.setdefault(r["lang"], []).append((str(r["doc_id"]), r["text"]))
    joined = {}
    for lang, texts in by_lang.items():
        texts.sort()
        room = max(1, sample_chars // len(texts))
        # Short texts leave room that longer ones may use.
        short = sum(max(0, room - len(t)) for _, t in texts)
        long_ones = sum(len(t) > room for _, t in texts)
        each = room + (short // long_ones if long_ones else 0)
        places = [zlib.crc32(f"{lang}/{i}".encode()) % max(1, len(t) - each + 1) for i, t in texts]
        joined[lang] = normalise(" ".join(t[at : at + each] for at, (_, t) in zip(places, texts, strict=True)))[:sample_chars]
    return tuple(sorted(joined.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score to ``docs``; only ``text`` is looked at.

    A null text, or one without a letter, is ``und`` with score 0. Of
    languages that need equally many bits the alphabetically first wins.
    Texts of any length are parsed as one. Rows with a null id and repeated
    rows are kept, and equal texts get equal values; an empty table gives an
    empty one. The new columns take other names of the caller's choosing
    through ``pred`` and ``score``.
    """

    @F.arrow_udf("lang string, score double")
    def parsed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            langs, shares = [], []
            for at in range(0, len(batch), ROWS_AT_ONCE):
                lang, share = classify(batch.slice(at, ROWS_AT_ONCE).to_pylist(), samples)
                langs += lang
                shares += share
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(shares, pa.float64())], names=["lang", "score"])

    both = fresh([*docs.columns, pred, score], "parsed")
    return docs.withColumn(both, parsed("text")).withColumns({pred: F.col(both)["lang"], score: F.col(both)["score"]}).drop(both)


def language_table(docs: DataFrame) -> DataFrame:
    """Learn from the labelled two thirds and predict every document: doc_id, held_out, lang_pred, score."""
    samples = learn(docs)
    mine = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return identify(mine, samples).select("doc_id", "held_out", "lang_pred", "score")
