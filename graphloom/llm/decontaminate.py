"""Benchmark decontamination, in DataFrame operations only.

Windows of a document that are as long as a benchmark item are SimHashed and
meet the item on multi-index Hamming blocks, which find all fingerprints
within the radius. An exact similarity over weighted five-word shingles then
verifies. A window can pass that test only if it shares one of an item's
rarest shingles, those that cannot all be missing, so only documents and items
that share one are compared: the windows' places follow from where all their
shared shingles stand in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, release, stage
from .simhash import WIDE, bit_counts, block_keys, fingerprint_of_counts, lane_sums, most

WIDTH = 5
SIMILARITY = 0.8
#: Of 63 bits. With it, recall of windows at a similarity of just 0.8 was 0.99 or more (``test_recall_against_all_windows``).
RADIUS = 20
#: Rows of the benchmark's shingle table that may be broadcast; beyond it the join is shuffled.
BROADCAST_SHINGLES = 1 << 18

_GAPS = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(text), _GAPS), "")


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Hashes of all ``width``-word shingles, in order; none if there are fewer words."""
    each = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))
    return F.slice(each, 1, F.greatest(F.size(words) - width + 1, F.lit(0)))


def _own_shingles(words: Column, widths: list[int]) -> Column:
    """Shingles of an item or of a window as long as one: of less than five words, all of them are the one shingle."""
    out = shingle_hashes(words)
    for w in widths:
        if w < WIDTH:
            out = F.when(F.size(words) == w, shingle_hashes(words, w)).otherwise(out)
    return out


def _print_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the SimHash ``sim`` over the words in column ``words``, however many."""
    parted = df.select(*keys, F.posexplode("words").alias("pos", "word")).withColumn("h", F.xxhash64("word"))
    summed = parted.groupBy(*keys, F.expr(f"pos DIV {most(WIDE)}").alias("part")).agg(*lane_sums(F.col("h")), F.count(F.lit(1)).alias("seen"))
    counted = summed.groupBy(*keys).agg(*bit_counts(WIDE), F.sum("seen").alias("seen"))
    return counted.select(*keys, fingerprint_of_counts(F.col("seen")).alias("sim"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Benchmark items found in documents: doc_id, row, item_id, first_word, n_words, distance, similarity.

    One row for each document and item, its best window (of equal ones the
    first). ``row`` is the hash of id and text. The similarity is twice the
    weight of the shared distinct shingles over the weight of both sides',
    where a shingle that k items hold weighs 1/k in the item and a window's
    other shingles weigh 1.

    Texts are compared in lower case by letters and digits, whole, and both
    texts and items may be of any length. An item of fewer than five words
    has all of them as its one shingle, so only just these words in this
    order are found. A null text, or one without a word, holds nothing and,
    as an item, is found nowhere. Repeated rows of documents give their
    result once; repeated items count once. Null ids are kept, and an empty
    table on either side gives an empty one.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    items = stage(items.select("item_id", F.xxhash64("words").alias("item"), "words", F.size("words").alias("m")), "leak-items")
    widths = sorted(r[0] for r in items.select(F.least("m", F.lit(WIDTH))).distinct().collect())
    different = items.select("item", "m", "words").dropDuplicates(["item"])
    flat = stage(different.select("item", "m", F.posexplode(_own_shingles(F.col("words"), widths)).alias("item_pos", "h")), "leak-shingles")
    weights = stage(flat.groupBy("h").agg((1.0 / F.countDistinct("item")).alias("weight")), "leak-weights")
    weighed = flat.select("item", "h").distinct().join(weights, "h")
    # A window that passes shares at least this part of the item's weight. So it shares one of the heaviest, rarest,
    # shingles: all but those that together weigh less.
    rarest_first = Window.partitionBy("item").orderBy(F.desc("weight"), "h")
    whole = F.sum("weight").over(Window.partitionBy("item"))
    before = F.coalesce(F.sum("weight").over(rarest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    asked = weighed.select("item", "h", (whole - before).alias("left"), whole.alias("item_weight"))
    asked = asked.where(F.col("left") >= F.lit(similarity / (2 - similarity)) * F.col("item_weight") - 1e-9).select("item", "h")
    places = stage(asked.select("h", "item"), "leak-places")
    if places.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES:
        places = F.broadcast(places)

    mine = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    # Words are a column of their own first: inside the shingles' lambda they would be split anew for each.
    positions = mine.select("doc_id", "row", words_of(F.col("text")).alias("words"))
    def shingled_at(words: Column) -> Column:
        each = [F.transform(shingle_hashes(words, w), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for w in widths or [WIDTH]]
        return each[0] if len(each) == 1 else F.concat(*each)

    hits = positions.select("doc_id", "row", F.explode(shingled_at(F.col("words"))["h"]).alias("h")).join(places, "h")
    met = stage(hits.select("doc_id", "row", "item").distinct(), "leak-pairs")

    # Only documents with a pair are read again.
    held = mine.join(met.select(F.col("row").alias("r")).distinct(), F.col("row") == F.col("r"), "left_semi")
    worded = stage(held.select("row", words_of(F.col("text")).alias("all")).dropDuplicates(["row"]), "leak-texts")
    placed = worded.select("row", F.explode(shingled_at(F.col("all"))).alias("p")).select("row", "p.pos", "p.h")
    spots = placed.join(met.select("row", "item").distinct(), "row").join(flat, ["item", "h"])
    spots = stage(spots.select("row", F.greatest(F.col("pos") - F.col("item_pos"), F.lit(0)).alias("first"), "m", "item").distinct(), "leak-spots")
    window = ["row", "first", "m"]
    windows = spots.select(*window).distinct().join(worded, "row").select(*window, F.slice("all", F.col("first") + 1, F.col("m")).alias("words"))
    windows = stage(windows, "leak-windows")

    blocks = radius + 1
    keyed = lambda df: df.withColumn("key", F.explode(block_keys(F.col("sim"), blocks, 1)))
    theirs = keyed(_print_of(different, ["item"])).select("key", "item", F.col("sim").alias("item_sim"))
    asking = spots.select(*window, "item").distinct().join(_print_of(windows, window), window)
    close = keyed(asking).join(theirs, ["key", "item"]).withColumn("distance", F.bit_count(F.col("sim").bitwiseXOR(F.col("item_sim"))))
    close = close.where(F.col("distance") <= radius).groupBy(*window, "item").agg(F.first("distance").alias("distance"))
    candidates = stage(close, "leak-candidates")

    own = weighed.groupBy("item").agg(F.collect_list("h").alias("theirs"), F.sum("weight").alias("item_weight"))
    shingled = windows.select(*window, F.array_distinct(_own_shingles(F.col("words"), widths)).alias("mine"))
    compared = candidates.join(shingled, window).join(own, "item")
    pair = [*window, "item", "distance", "item_weight"]
    shared = F.array_intersect("mine", "theirs")
    compared = compared.select(*pair, shared.alias("shared"), (F.size("mine") - F.size(shared)).alias("other"))
    summed = compared.select(*pair, "other", F.explode("shared").alias("h")).join(weights, "h").groupBy(*pair, "other").agg(F.sum("weight").alias("both"))
    scored = summed.withColumn("similarity", 2 * F.col("both") / (F.col("item_weight") + F.col("both") + F.col("other")))
    named = scored.where(F.col("similarity") >= similarity - 1e-9).join(items.select("item_id", "item").distinct(), "item")
    best = F.max_by(F.struct("first", "m", "distance", "similarity"), F.struct("similarity", -F.col("first"))).alias("b")
    best = named.groupBy("row", "item_id").agg(best)
    # Ids may be null, so rows are told apart by their hash up to here.
    out = best.join(met.select("doc_id", "row").distinct(), "row").select(
        "doc_id", "row", "item_id", F.col("b.first").alias("first_word"), F.col("b.m").alias("n_words"), "b.distance", "b.similarity"
    )
    out = stage(out, "leak-found")
    release(items, flat, weights, places, met, worded, spots, windows, candidates)
    return out


def leak_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark).drop("row")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the input's columns."""
    leaked = fresh(docs.columns, "leaked")
    found = stage(leaks(docs, benchmark).select(F.col("row").alias(leaked)).distinct(), "leak-rows")
    return docs.join(found, F.xxhash64("doc_id", "text") == F.col(leaked), "left_anti")
