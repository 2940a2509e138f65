"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Pieces and their ranks come from a public merge-type vocabulary. Encoding
runs an agenda of candidate merges, best rank first; a hash keyed by seed,
document, place and candidate decides whether each is skipped, so one seed
gives one segmentation of a document, words are cut anew wherever they stand,
and other seeds or documents give others. Whatever is skipped, the pieces
spell the text, and decoding returns it byte for byte.

The agendas of all words of one length run in step: each round takes the best
candidate of every word, skips or merges it, and looks up the one or two new
pairs, in array operations. Words are never compared or kept, so costs do not
depend on how many different ones there are. Longer words have an agenda of
their own.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 4
DROPOUT = 0.1
#: Words up to this length (at most 64) run in step.
SHORT = 48
#: Characters that are encoded together, about.
CHARS_AT_ONCE = 1 << 19
#: Candidates of a longer word that are decided at once.
DRAWN = 256

_NONE = np.int32(1 << 30)
_GONE = np.int32(-1)
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLACE, _CANDIDATE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _skipped(keys: np.ndarray, number: int | np.ndarray, dropout: float) -> np.ndarray:
    """Whether candidate ``number`` of the words with these keys is skipped."""
    x = keys + np.atleast_1d(np.asarray(number, np.uint64)) * _CANDIDATE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches from ``starts``, of ``sizes``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Pairs:
    """The piece that two adjacent symbols make: an open-addressed table."""

    def __init__(self, made: dict[tuple[int, int], int], symbols: int):
        self.symbols = symbols
        bits = max(4, (4 * len(made)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for (a, b), piece in made.items():
            key = a * (symbols + 1) + b
            at = int(self._slots(np.array([key]))[0])
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, piece

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece numbers, ``_NONE`` where the symbols make none."""
        keys = np.minimum(left, self.symbols).astype(np.int64) * (self.symbols + 1) + np.minimum(right, self.symbols)
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            same = found == keys[todo]
            out[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same & (found != -1)]
        return out


class Pieces:
    """The vocabulary: ranks of mergeable pieces, bytes of every id, and where texts may be cut.

    Symbols are numbers: a piece's rank, then characters that only stand in
    pieces, then one for the end of a word, then all other characters by
    their code.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(sp.vocab_size())]
        byte = [sp.is_byte(i) for i in range(sp.vocab_size())]
        named = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        # A blank stands for the space marker here, so the marker itself is like any other unlisted character.
        self.ids = {p.replace("▁", " "): i for i, p in enumerate(named) if not special[i] and not byte[i]}
        order = sorted(self.ids, key=lambda p: (-sp.get_score(self.ids[p]), self.ids[p]))
        self.rank = {p: r for r, p in enumerate(order)}
        of_byte = {int(p[3:5], 16): i for i, p in enumerate(named) if byte[i]}
        if len(of_byte) != 256:
            raise ValueError("lossless decoding needs a vocabulary with byte fallback")
        self.of_byte = np.array([of_byte[b] for b in range(256)], np.int32)
        back = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in of_byte.items()}
        self.bytes_of = [back.get(i, b"") for i in range(sp.vocab_size())]
        self._pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._sizes = np.array(list(map(len, self.bytes_of)))
        self._starts = np.cumsum(self._sizes) - self._sizes

        self.id_of = np.array([self.ids[p] for p in order], np.int32)
        inner = sorted(set("".join(order)) - set(order))
        number = self.rank | {c: len(order) + k for k, c in enumerate(inner)}
        self.end = len(number)
        self.symbol = np.arange(0x110000, dtype=np.int32) + np.int32(self.end + 1)
        for c, k in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = k
        made = {(number[p[:k]], number[p[k:]]): r for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.pairs = _Pairs(made, self.end)
        # Texts can be cut where no piece of the vocabulary crosses: before blanks, at line feeds, and
        # between Latin letters and what is neither a letter nor a blank.
        crossed = [re.compile(x) for x in (r"[^ ] ", r"\n.|.\n", f"[{_LATIN}][^{_LATIN} ]|[^{_LATIN} ][{_LATIN}]")]
        self.whole, line, mixed = (any(x.search(p) for p in self.ids) for x in crossed)
        latin = re.compile(f"[{_LATIN}]")
        #: 0 blanks, 1 line feeds, 2 Latin letters, 3 others.
        self.kind = np.full(0x110000, 3, np.int8)
        self.kind[[i for i in range(0x250) if latin.match(chr(i))]] = 3 if mixed else 2
        self.kind[ord("\n")] = 3 if line else 1
        self.kind[ord(" ")] = 0

    def parts(self, text: str) -> Iterator[str]:
        """The text; a very long one in parts that no piece crosses."""
        at = 0
        while not self.whole and len(text) - at > CHARS_AT_ONCE:
            stop = text.find(" ", at + CHARS_AT_ONCE)
            while stop > 0 and text[stop - 1] == " ":
                stop = text.find(" ", stop + 1)
            if stop < 0:
                break
            yield text[at:stop]
            at = stop
        yield text[at:] if at else text

    def word_starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the words of texts begin that lie one after the other from ``first``."""
        cut = np.zeros(len(codes), bool)
        if not self.whole:
            kind = self.kind[codes]
            now, last = kind[1:], kind[:-1]
            cut[1:] = ((now == 0) & (last != 0)) | (now == 1) | (last == 1) | ((now != last) & (now != 0) & (last != 0))
        cut[first] = True
        return np.flatnonzero(cut)

    def in_step(self, symbols: np.ndarray, keys: np.ndarray, dropout: float) -> np.ndarray:
        """Symbols of words of one length (a column each) after their agendas, ``_GONE`` where a symbol went into another."""
        size, n = symbols.shape
        done = np.empty((size, n), np.int32)
        at = np.arange(n)
        # A last row stands for what lies beyond both ends.
        sym = np.vstack([symbols, np.full((1, n), self.end, np.int32)])
        after = np.repeat(np.minimum(np.arange(1, size + 2), size).astype(np.int32)[:, None], n, axis=1)
        before = np.repeat(np.concatenate([[size], np.arange(size)]).astype(np.int32)[:, None], n, axis=1)
        best_at = np.arange(size + 1, dtype=np.int32)[:, None]
        pair = np.full((size + 1, n), _NONE, np.int32)
        made = self.pairs(sym[:-1].ravel(), sym[1:].ravel()).reshape(size, n)
        # Rank and place in one number: the smallest is the best, the first of equal ones.
        pair[:-1] = np.where(made == _NONE, _NONE, made * 64 + best_at[:-1])
        asked = 0
        while True:
            best = pair.min(axis=0)
            live = np.flatnonzero(best != _NONE)
            if len(live) < n // 2 or not len(live):
                done[:, at] = sym[:-1]
                if not len(live):
                    return done
                at, keys, best, n = at[live], keys[live], best[live], len(live)
                sym, after, before, pair = (x.take(live, axis=1) for x in (sym, after, before, pair))
                live = np.arange(n)
            best = best[live]
            i, piece = best & 63, best >> 6
            if dropout > 0.0:
                skips = _skipped(keys[live], asked, dropout)
                pair[i[skips], live[skips]] = _NONE
                live, i, piece = live[~skips], i[~skips], piece[~skips]
            asked += 1
            s, a, b, p = sym.ravel(), after.ravel(), before.ravel(), pair.ravel()
            here = i * n + live
            right = a[here]
            gone = right * n + live
            beyond, left = a[gone], b[here]
            s[here], s[gone], p[gone] = piece, _GONE, _NONE
            a[here] = beyond
            b[beyond * n + live] = i
            far, near = beyond * n + live, left * n + live
            made = self.pairs(np.concatenate([piece, s[near]]), np.concatenate([s[far], piece]))
            ranked = np.where(made == _NONE, _NONE, made * 64 + np.concatenate([i, left]))
            p[here], p[near] = ranked[: len(live)], ranked[len(live) :]

    def agenda(self, word: str, skips: Callable[[], bool] | None = None) -> list[str]:
        """Parts of one word of any length, by a heap; ``skips`` is asked for one candidate after the other."""
        rank = self.rank
        n = len(word)
        ends = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        bits = 22 if n < 1 << 22 else 44
        low = (1 << bits) - 1
        agenda = []
        for i, pair in enumerate(map(str.__add__, word, word[1:])):
            r = rank.get(pair)
            if r is not None:
                agenda.append((r << 2 * bits) | (i << bits) | (i + 2))
        heapq.heapify(agenda)
        gone = bytearray(n + 1)
        while agenda:
            top = heapq.heappop(agenda)
            left, end = top >> bits & low, top & low
            mid = ends[left]
            # A candidate is stale once either side was merged elsewhere.
            if gone[left] or mid >= end or ends[mid] != end:
                continue
            if skips and skips():
                continue
            gone[mid] = 1
            ends[left] = end
            if end < n:
                before[end] = left
                stop = ends[end]
                r = rank.get(word[left:stop])
                if r is not None:
                    heapq.heappush(agenda, (r << 2 * bits) | (left << bits) | stop)
            p = before[left]
            if p >= 0:
                r = rank.get(word[p:end])
                if r is not None:
                    heapq.heappush(agenda, (r << 2 * bits) | (p << bits) | end)
        parts, at = [], 0
        while at < n:
            parts.append(word[at : ends[at]])
            at = ends[at]
        return parts

    def long_word(self, word: str, key: np.ndarray, dropout: float) -> np.ndarray:
        """Symbols of a word of any length; the same as in step."""

        def drawn() -> Iterator[bool]:
            number = np.arange(DRAWN)
            while True:
                yield from _skipped(key, number, dropout).tolist()
                number += DRAWN

        parts = self.agenda(word, drawn().__next__ if dropout > 0.0 else None)
        return np.array([self.rank[p] if p in self.rank else self.symbol[ord(p)] for p in parts], np.int32)

    def numbers(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and how many each has: characters without a piece are spelt in bytes."""
        plain = symbols < len(self.id_of)
        if plain.all():
            return self.id_of[symbols], np.ones(len(symbols), np.int64)
        code = np.where(symbols > self.end, symbols - (self.end + 1), 0)
        for k in np.unique(symbols[~plain & (symbols < self.end)]):
            code[symbols == k] = np.flatnonzero(self.symbol == k)[0]
        sizes = np.where(plain, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        each = np.repeat(np.arange(len(symbols)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(each)) - 1
        size, code = sizes[each], code[each] >> 6 * left
        # The first byte of several says how many there are; the others have six bits each.
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
        byte = np.where(size == 1, code, np.where(left == size - 1, lead | code, 0x80 | code & 0x3F)) & 0xFF
        return np.where(plain[each], self.id_of[np.where(plain, symbols, 0)][each], self.of_byte[byte]), sizes

    def spelt(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, the blank put before the text included."""
        parts = (ids[at : at + CHARS_AT_ONCE] for at in range(0, len(ids), CHARS_AT_ONCE))
        return b"".join(self._pool[_spread(self._starts[x], self._sizes[x])].tobytes() for x in parts)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text that the ids spell; the blank put before it goes."""
        return self.spelt(np.asarray(ids, np.int32))[1:].decode("utf-8", "surrogatepass")


class Encoder:
    """Encodes texts under one vocabulary, seed and dropout rate; every candidate at every place of every document is decided on its own."""

    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = SEED):
        if not 0.0 <= dropout <= 1.0:
            raise ValueError("dropout is a share from 0 to 1")
        self.pieces = Pieces(model)
        self.seed, self.dropout = seed, dropout

    def key(self, doc_id: int | None) -> int:
        return xxhash.xxh3_64_intdigest(f"{self.seed}/{doc_id}")

    def encode(self, text: str | None, doc_id: int | None = None) -> np.ndarray:
        """Ids of a whole text; none for a null or empty one."""
        return self.encode_many([text], [doc_id])[0]

    def encode_many(self, texts: list[str | None], doc_ids: list[int | None]) -> list[np.ndarray]:
        """Ids of each text; the same as one by one."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str, int]] = []
        size = 0

        def flush() -> int:
            nonlocal size
            words = 0
            if held:
                ids, words = self._encoded([t for _, t, _ in held], [k for _, _, k in held])
                for (i, _, _), got in zip(held, ids, strict=True):
                    out[i].append(got)
            held.clear()
            size = 0
            return words

        for i, (text, doc_id) in enumerate(zip(texts, doc_ids, strict=True)):
            if not text:
                continue
            key = self.key(doc_id)
            if len(text) >= CHARS_AT_ONCE:
                flush()
                for part in self.pieces.parts(" " + text):
                    held.append((i, part, key))
                    # Places count on from part to part.
                    key = (key + flush() * int(_PLACE)) % (1 << 64)
                continue
            held.append((i, " " + text, key))
            size += len(text)
            if size >= CHARS_AT_ONCE:
                flush()
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, np.int32) for x in out]

    def _encoded(self, texts: list[str], keys: list[int]) -> tuple[list[np.ndarray], int]:
        """Ids of each text, and the number of words in all."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(list(map(len, texts)))
        first = np.concatenate([[0], ends[:-1]])
        starts = self.pieces.word_starts(codes, first)
        sizes = np.diff(np.append(starts, len(codes)))
        begins = np.searchsorted(starts, first)
        counts = np.diff(np.append(begins, len(starts)))
        place = (np.arange(len(starts)) - np.repeat(begins, counts)).astype(np.uint64)
        word_keys = np.repeat(np.array(keys, np.uint64), counts) + place * _PLACE
        symbols = self.pieces.symbol[codes]

        found: list[tuple[np.ndarray, np.ndarray]] = []
        parts = np.ones(len(starts), np.int64)
        order = np.argsort(sizes, kind="stable")
        bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1))
        for words in np.split(order, bounds[1:]):
            size = int(sizes[words[0]])
            if size > SHORT:
                for w in words.tolist():
                    got = self.pieces.long_word(joined[starts[w] : starts[w] + size], word_keys[w : w + 1], self.dropout)
                    parts[w] = len(got)
                    found.append((np.array([w]), got))
                continue
            grid = symbols[starts[words] + np.arange(size)[:, None]]
            if size > 1:
                grid = self.pieces.in_step(grid, word_keys[words], self.dropout)
            rows = np.ascontiguousarray(grid.T)
            left = rows != _GONE
            parts[words] = left.sum(axis=1)
            found.append((words, rows[left]))
        at = np.cumsum(parts) - parts
        made = np.empty(int(parts.sum()), np.int32)
        for words, got in found:
            made[_spread(at[words], parts[words])] = got
        ids, sizes = self.pieces.numbers(made)
        stops = np.cumsum(np.add.reduceat(sizes, at[begins]))
        return np.split(ids, stops[:-1]), len(starts)


@lru_cache(maxsize=4)
def _encoder(model: bytes, dropout: float, seed: int) -> Encoder:
    return Encoder(model, dropout, seed)


SCHEMA = "doc_id long, ids array<int>, n_tokens long, n_bytes long, lossless boolean"


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Encode every whole text: doc_id, ids, n_tokens, n_bytes and whether decoding gave the text back.

    The driver reads the vocabulary and sends it along. A null or empty text
    has no ids; texts of any length are encoded whole, cut only where no
    piece can cross. Equal ids and texts give equal rows; a null id is a key
    of its own. An empty table gives an empty one. Only ``doc_id`` and
    ``text`` are read.
    """
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, dropout, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                ids = encoder.encode_many(texts, part.column(0).to_pylist())
                raw = [text.encode("utf-8", "surrogatepass") if text else b"" for text in texts]
                same = [encoder.pieces.spelt(got)[1:] == x for got, x in zip(ids, raw, strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32())),
                        pa.array(np.diff(ends), pa.int64()), pa.array(list(map(len, raw)), pa.int64()), pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "n_bytes", "lossless"],
                )

    return docs.select("doc_id", "text").mapInArrow(encoded, SCHEMA)


def decode_documents(tokens: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """Texts of encoded documents: doc_id, text. No ids give the empty text, null ids a null one."""
    with open(model_path, "rb") as f:
        sent = tokens.sparkSession.sparkContext.broadcast(f.read())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(sent.value, 0.0, SEED).pieces
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")
