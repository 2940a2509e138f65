"""Fuzzy line deduplication, in DataFrame operations only.

Lines are normalised. Lines that can be near copies meet on the rarest of
their short word sequences, of which any two within the edit similarity share
one; they are verified by edit similarity over words, and one occurrence of
each connected group of lines is kept. With a radius given, lines meet on
pigeonhole blocks of their SimHashes instead, which finds only those whose
fingerprints are within it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, release, stage
from .components import linked_components
from .simhash import NARROW, bit_counts, block_keys, fingerprint, fingerprint_of_counts, key_space, lane_sums, most, plan

#: Of ``line_groups`` unless it is given another; deduplication has none.
RADIUS = 3
#: Least share of the longer line's words that an alignment leaves in place.
SIMILARITY = 0.8
#: Tables by block key up to this many rows are broadcast.
BROADCAST_KEYS = 1 << 18

#: Shares of all word sequences that are counted one after the other.
PASSES = 2
#: Buckets of line hashes that are broadcast, at most.
LINE_BUCKETS = 1 << 17

#: Longs of a line's bit map. It tells little about lines of over 500 words, of which more pairs are left to the edit distance.
MAP_LONGS = 8

#: Characters of Unicode, without surrogates.
_CHARACTERS = 0x110000 - 0x800

_GAPS = r"[^\p{L}\p{N}]+"


def normalised(line: Column) -> Column:
    """Lower case, letters and digits only, words parted by one blank."""
    return F.trim(F.regexp_replace(F.lower(line), _GAPS, " "))


def _words(norm: Column) -> Column:
    """A 32-bit hash of each word."""
    return F.transform(F.split(norm, " "), lambda w: F.hash(w))


def _text(points: Column) -> Column:
    """A text of the characters with these numbers, from 0 to ``_CHARACTERS`` - 1."""
    skipped = F.lit(0xD800)  # where the code points that stand for no character begin
    point = lambda p: F.lpad(F.hex(F.when(p < skipped, p).otherwise(p + 0x800)), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(points, point), "")), "UTF-32")


def _within(edits: str) -> Column:
    """True where the edit distance over the words of two lines (x and y: words, points, text) is at most ``edits``.

    Words are first compared by their characters in ``text``. Where two words
    of the pair have one character, they are numbered within the pair, by their
    first place in the second line. (Lines of over 1,112,000 words wrap.)
    """
    parted = F.size(F.array_union("x.words", "y.words")) == F.size(F.array_union("x.points", "y.points"))
    numbered = [_text(F.transform(f"{side}.words", lambda w: F.pmod(F.array_position("y.words", w), F.lit(_CHARACTERS)))) for side in "xy"]
    exact = F.call_function("levenshtein", *numbered, F.expr(edits)) >= 0
    return F.expr(f"levenshtein(x.text, y.text, {edits}) >= 0") & F.when(parted, F.lit(True)).otherwise(exact)


def _lines(docs: DataFrame) -> DataFrame:
    """All lines with a word: doc_id, row (hash of id and text), copy (a number of this very row), line_no, norm."""
    # What stands beside a generator is computed for each row it makes, so all else goes before.
    whole = docs.where("text IS NOT NULL").select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row"), F.monotonically_increasing_id().alias("copy"), F.split("text", "\n").alias("lines")
    )
    lines = whole.select("doc_id", "row", "copy", F.posexplode("lines").alias("line_no", "line"))
    return lines.select("doc_id", "row", "copy", "line_no", normalised(F.col("line")).alias("norm")).where("norm <> ''")


def _line_prints(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, line_no, node, n, sim)`` of all lines with a word: hash, number of words and fingerprint."""
    keys = ["doc_id", "row", "line_no", "node", "n"]
    parted = _lines(docs).select("doc_id", "row", "copy", "line_no", F.xxhash64("norm").alias("node"), F.split("norm", " ").alias("words"))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    parted = parted.select("doc_id", "row", "copy", "line_no", "node", F.size("words").alias("n"), hashes.alias("hashes"))
    # Lanes for a part of a line are narrow; a longer line has several parts, whose counts are added up afterwards.
    parted = parted.select(*keys, "copy", F.posexplode("hashes").alias("pos", "h")).withColumn("part", F.expr(f"pos DIV {most(NARROW)}"))
    summed = parted.groupBy(*keys, "copy", "part").agg(*lane_sums(F.col("h"), NARROW))
    short = F.col("n") <= most(NARROW)
    lanes = [F.when(~short, F.col(f"lane{j}")).alias(f"lane{j}") for j in range(NARROW)]
    summed = stage(summed.select(*keys, "copy", F.when(short, fingerprint(F.col("n"), NARROW)).alias("sim"), *lanes), "line-sums")
    long = summed.where("sim IS NULL").groupBy(*keys, "copy").agg(*bit_counts(NARROW))
    out = [*keys, "sim"]
    return summed.where("sim IS NOT NULL").select(out).unionByName(long.withColumn("sim", fingerprint_of_counts(F.col("n"))).select(out))


def _line_places(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, line_no, node, words)`` of all lines with a word: hash, and hashes of the words."""
    return _lines(docs).select("doc_id", "row", "line_no", F.xxhash64("norm").alias("node"), _words(F.col("norm")).alias("words"))


def _bit_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, m0, m1, ...)`` of batches (node, words): a bit for each word and how often it stood before in its line."""
    bits = 64 * MAP_LONGS
    for batch in batches:
        n, words = np.diff(batch.column("words").offsets.to_numpy()), batch.column("words").flatten().to_numpy().astype(np.int64)
        line = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((words, line))
        line, words, at = line[order], words[order], np.arange(len(order))
        again = np.zeros(len(order), bool)
        again[1:] = (line[1:] == line[:-1]) & (words[1:] == words[:-1])
        seen = at - np.maximum.accumulate(np.where(again, 0, at))
        marks = np.zeros(bits * len(n), bool)
        marks[bits * line + ((words * 31 + seen * 0x9E3779B1) >> 3) % bits] = True
        maps = np.packbits(marks, bitorder="little").view("<i8").reshape(-1, MAP_LONGS)
        columns = [pa.array(np.ascontiguousarray(maps[:, k])) for k in range(MAP_LONGS)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], ["node", *[f"m{k}" for k in range(MAP_LONGS)]])


def _sequences(share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(id, h)`` of batches (id, words, lengths): hashes of all sequences of these lengths that are in one share of ``PASSES``.

    The last two bits tell the length. Sequences whose hashes meet make candidates only, so 48 bits do.
    """

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, lengths = (batch.column(c) for c in ("id", "words", "lengths"))
            n = np.diff(words.offsets.to_numpy())
            ids, words = ids.to_numpy(), words.flatten().to_numpy().astype(np.uint32).astype(np.uint64)
            line = np.repeat(np.arange(len(n)), n)
            left = np.repeat(np.cumsum(n), n) - np.arange(len(words))  # words from here to the line's end
            of, asked = np.repeat(np.arange(len(n)), np.diff(lengths.offsets.to_numpy())), lengths.flatten().to_numpy()
            for q in (1, 2, 3):
                wanted = np.zeros(len(n), bool)
                wanted[of[asked == q]] = True
                at = np.flatnonzero(wanted[line] & (left >= q))
                h = np.full(len(at), q, np.uint64)
                for k in range(q):
                    h = (h ^ words[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(29)
                mine = (h >> np.uint64(2)) % np.uint64(PASSES) == share
                h = (h[mine] & np.uint64((1 << 48) - 4) | np.uint64(q)).view(np.int64)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[line[at[mine]]]), pa.array(h)], ["id", "h"])

    return sequences


def _edits(n: str, similarity: float) -> str:
    """Most edits that a longer line of ``n`` words can have."""
    return f"CAST(floor({1 - similarity} * {n} + 1e-9D) AS INT)"


def _rare_keys(words: DataFrame, similarity: float) -> DataFrame:
    """``(node, n, b0, b1, key, before)`` of lines ``(id, node, n, words, b0, b1)``.

    ``d`` edits break at most ``q * d`` of a line's q-word sequences, and an
    edit that only the longer line has breaks ``q - 1`` of the shorter one's.
    So of their sequences, rare ones first in one order for all lines, one that
    both have is among the first of either that are one more than can be broken.
    Sequences are of three words, or of fewer where edits could break all.
    ``b0`` and ``b1`` have a bit for each word: a pair has no more bits on one
    side only than edits. ``before`` is the line's key before this one.
    """
    longest = f"CAST(floor(n / {similarity}D + 1e-9D) AS INT)"
    partners = f"sequence(n, {longest})"
    left = {q: f"(m - {q} * {_edits('m', similarity)} >= {q})" for q in (1, 2, 3)}
    used = {3: left[3], 2: f"NOT {left[3]} AND {left[2]}", 1: f"NOT {left[3]} AND NOT {left[2]}"}

    lengths = F.array_compact(F.array(*[F.when(F.expr(f"exists({partners}, m -> {used[q]})"), F.lit(q)) for q in (1, 2, 3)]))
    nearest = partners
    if (rest := 1 - 3 * (1 - similarity)) > 0:
        # From so many words on three-word sequences do for all partners, and no partner longer by so many has more of them broken.
        enough = ceil(3 / rest) + 1
        lengths = F.when(F.col("n") >= enough, F.array(F.lit(3))).otherwise(lengths)
        nearest = f"sequence(n, least({longest}, n + {enough}))"
    sized = words.select("id", "words", lengths.alias("lengths"))
    # Sequences that come up once stand first in the order, and need no more than be counted. A pass holds one share of the sequences on disk.
    passes = []
    for k in range(PASSES):
        # Counted and looked up in one shuffle (both sides read ``id``, so it is the same one) and without sorting.
        some = sized.mapInArrow(_sequences(k), "id long, h long").repartition("h")
        several = some.groupBy("h").agg(F.count("id").alias("c")).where("c > 1")
        some = some.join(several.hint("shuffle_hash"), "h")
        # Ordered by count in 15 bits (500 steps for each doubling), then by hash: any order that all lines share will do.
        ranked = F.shiftleft(F.floor(F.log2("c") * 500).cast("long"), 48).bitwiseOR(F.col("h"))
        passes.append(stage(some.select("id", ranked.alias("key")), "line-shared"))
    shared = reduce(DataFrame.unionByName, passes).withColumn("q", F.expr("CAST(key & 3 AS INT)"))
    # A line's own sequences, of which it has no more than words.
    own = Window.partitionBy("id", "q")
    at = {"at": F.row_number().over(own.orderBy("key")), "before": F.lag("key").over(own.orderBy("key")), "size": F.count(F.lit(1)).over(own)}
    # By length of sequence, and once for each line.
    broken = F.expr(f"transform(array(1, 2, 3), q -> array_max(transform({nearest}, m -> q * {_edits('m', similarity)} - (m - n))))")
    shared = shared.repartition("id").withColumns(at).join(words.select("id", "node", "n", "b0", "b1", broken.alias("broken")), "id")
    kept = F.get("broken", F.col("q") - 1) + 1 - (F.col("n") - F.col("q") + 1 - F.col("size"))
    first = (F.col("at") <= kept) & ~F.col("before").eqNullSafe(F.col("key"))
    keys = stage(shared.where(first).select("node", "n", "b0", "b1", "key", "before"), "line-keys")
    release(*passes)
    return keys


def _linked_lines(docs: DataFrame, radius: int | None, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines; the different ones ``(node, place, c, ...)`` with their first place and count; ``(node, comp)`` of those in a group."""
    mine = docs.select("doc_id", "text")
    lines = stage(_line_places(mine), "line-rows") if radius is None else _line_prints(mine)
    own = ["words"] if radius is None else ["sim", "n"]
    different = lines.groupBy("node").agg(
        F.min(F.struct("doc_id", "row", "line_no")).alias("place"), *[F.first(c).alias(c) for c in own], F.count(F.lit(1)).alias("c")
    )
    if radius is None:
        bits = [F.expr(f"aggregate(words, 0L, (a, w) -> a | shiftleft(1L, shiftrightunsigned(w, {6 * k}) & 63))").alias(f"b{k}") for k in range(2)]
        # The number of a line is narrower in shuffles than its hash.
        number = F.monotonically_increasing_id().alias("id")
        different = different.select(number, "node", "place", "c", F.size("words").alias("n"), "words", *bits)
    different = stage(different, "line-different")
    if radius is None:
        # From here on the words of the different lines do.
        whole, lines = lines, stage(lines.select("doc_id", "row", "line_no", "node"), "line-places")
        release(whole)
    # So few words that even one of them in a longer partner is too many: equal lines only.
    shortest = next(n for n in range(1, 1000) if (1 - similarity) * (n + 1) >= 1 - 1e-9)

    def near(left: str, right: str) -> str:
        sizes = f"least({left}n, {right}n) >= {similarity} * greatest({left}n, {right}n) - 1e-9D"
        if radius is not None:
            return f"bit_count({left}sim ^ {right}sim) <= {radius} AND {sizes}"
        edits = _edits(f"greatest({left}n, {right}n)", similarity)
        sides = [f"bit_count({x}b{k} & ~{y}b{k}) <= {edits}" for k in range(2) for x, y in ((left, right), (right, left))]
        return " AND ".join([sizes, *sides])

    def verify(pairs: DataFrame) -> DataFrame:
        asked = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "line-asked")
        known = different if radius is None else _lines(mine).select(F.xxhash64("norm").alias("node"), _words(F.col("norm")).alias("words"))
        # Most lines are not asked for: a broadcast table of hash buckets, of bounded size, keeps them out of the shuffle.
        bucket = F.pmod(F.col("node"), F.lit(LINE_BUCKETS))
        known = known.select("node", "words").join(F.broadcast(asked.select(bucket.alias("b")).distinct()), bucket == F.col("b"), "left_semi")
        known = known.join(asked, "node", "left_semi")
        known = known if radius is None else known.dropDuplicates(["node"])
        points = F.transform("words", lambda w: F.pmod(w, F.lit(_CHARACTERS)))
        words = stage(known.withColumn("points", points).withColumn("text", _text(F.col("points"))), "line-asked-words")
        sides = {x: words.select(F.col("node").alias(k), F.struct("words", "points", "text").alias(x)) for k, x in (("a", "x"), ("b", "y"))}
        met = pairs.join(sides["x"], "a").join(sides["y"], "b")
        near = stage(met.where(_within(_edits("greatest(size(x.words), size(y.words))", similarity))).select("a", "b"), "line-near")
        release(asked, words)
        return near

    if radius is None:
        keys = _rare_keys(different.where(F.col("n") >= shortest), similarity)
        longs = [f"m{k}" for k in range(MAP_LONGS)]
        maps = different.where(F.col("n") >= shortest).select("node", "words").mapInArrow(_bit_maps, f"node long, {' long, '.join(longs)} long")

        def closer(left: str, right: str) -> str:
            edits = _edits(f"greatest({left}n, {right}n)", similarity)
            own = [" + ".join(f"bit_count({x}{m} & ~{y}{m})" for m in longs) for x, y in ((left, right), (right, left))]
            return " AND ".join(f"{bits} <= {edits}" for bits in own)

        # Two lines with one key before this have met there: of a run of keys that both have, the first makes the pair.
        def once(left: str, right: str) -> str:
            return f"coalesce({left}before <> {right}before, true)"

        comp = stage(linked_components(keys, lambda df: df, near, verify, ["n", "b0", "b1"], closer=(maps, closer), once=("before", once)), "line-linked")
        release(keys)
        return lines, different, comp
    fuzzy = different.where(F.col("n") >= shortest).select("node", "sim", "n")
    blocks, agree = plan(fuzzy.count(), radius)

    def expand(df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.explode(block_keys(F.col("sim"), blocks, agree)))

    comp = linked_components(fuzzy, expand, near, verify, ["sim", "n"], key_space(blocks, agree) <= BROADCAST_KEYS)
    return lines, different, comp


def line_groups(docs: DataFrame, radius: int | None = RADIUS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Every line's place and hash, and the groups of different lines that links join.

    Returns ``(doc_id, row, line_no, node)`` and ``(node, comp)``; lines that
    are in no group are not in the second table.
    """
    lines, _, comp = _linked_lines(docs, radius, similarity)
    return lines.select("doc_id", "row", "line_no", "node"), comp


def dropped_lines(docs: DataFrame, radius: int | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """Lines to drop, by row of the table: row and the numbers of all lines that are not their group's first."""
    lines, different, comp = _linked_lines(docs, radius, similarity)
    # Only lines that occur again, or are in a group, can be dropped.
    several = different.select("node", "place", "c").join(comp, "node", "left").where("c > 1 OR comp IS NOT NULL")
    several = stage(several.select("node", "place", F.coalesce("comp", "node").alias("comp")), "line-several")
    leads = stage(several.groupBy("comp").agg(F.min("place").alias("lead")), "line-comps")
    leads = stage(several.join(leads, "comp").select("node", "lead"), "line-leads")
    placed = lines.select("doc_id", "row", "line_no", "node").join(leads, "node")
    placed = placed.where(~F.struct("doc_id", "row", "line_no").eqNullSafe(F.col("lead")))
    return placed.groupBy("row").agg(F.collect_set("line_no").alias("dropped"))


def dedup_lines(docs: DataFrame, radius: int | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """Every document with its kept lines: the input's columns, ``text`` rewritten, and the numbers of lines and dropped lines.

    Lines are parted by line feeds and compared in lower case by letters and
    digits. Two lines link if the edit distance over words is at most 1 -
    ``similarity`` of the longer one and, where a ``radius`` is given, their
    63-bit SimHashes over words are within it; of each connected group the occurrence with the
    smallest (doc_id, row hash, line number) stays. Lines without a letter or
    digit always stay. Adds n_lines and n_dropped; ``n_chars``, if there, is
    set to the new length.

    A null text stays null. A null id sorts first. Repeated rows (same id and
    text) are treated alike: what is kept of one is kept of the other. An
    empty table gives an empty one, and columns with clashing names keep
    theirs. Lines are identified by 64-bit hashes, words by 32-bit ones.
    """
    row, lines, dropped, total, gone = (fresh(docs.columns, n) for n in ("row", "lines", "dropped", "n_lines", "n_dropped"))
    drops = stage(dropped_lines(docs, radius, similarity).select(F.col("row").alias(row), F.col("dropped").alias(dropped)), "line-drops")
    out = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(drops, row, "left")
    out = out.withColumn(lines, F.split("text", "\n"))
    kept = F.filter(
        F.transform(F.col(lines), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda s: ~F.array_contains(F.col(dropped), s["i"]),
    )
    text = F.when(F.col(dropped).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    out = out.withColumns(
        {total: F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)), gone: F.coalesce(F.size(dropped), F.lit(0)), "text": text}
    )
    names = {c: F.col(c) for c in docs.columns}
    if "n_chars" in names:
        names["n_chars"] = F.when(F.col(dropped).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")).alias("n_chars")
    return out.select(*names.values(), total, gone)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines and n_dropped of every document."""
    return dedup_lines(docs.select("doc_id", "text"))
