"""Connected components by alternating stars, and linking through shared keys without all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage

#: Rounds of large and small stars before giving up; chains of n nodes need about log2(n).
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of the undirected ``edges`` (a, b): comp is the component's smallest node.

    Each round hangs every node's neighbours on the smallest one, first the
    larger neighbours, then the smaller (two aggregations and two joins);
    nothing is gathered by node, so a hub's edges can be split. Rounds are
    written to the shared folder.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stage(links, "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
            )
        seen = mark
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "links-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        done, links = links, stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        release(done, large)
    raise RuntimeError("components did not settle")


def linked_components(
    nodes: DataFrame,
    expand: Callable[[DataFrame], DataFrame],
    near: Callable[[str, str], str],
    verify: Callable[[DataFrame], DataFrame],
    carry: list[str],
    few_keys: bool = False,
    enough: Callable[[str, str], str] | None = None,
    alone: str | None = None,
    central: str | None = None,
    closer: tuple[DataFrame, Callable[[str, str], str]] | None = None,
    once: tuple[str, Callable[[str, str], str]] | None = None,
) -> DataFrame:
    """``(node, comp)`` of everything in ``nodes`` (node, *carry, ...) that true links join.

    ``expand`` turns nodes into rows with a ``key``; rows that share one are
    candidates. ``near(l, r)`` is a cheap SQL test on the carried columns
    under two prefixes, ``verify`` turns pairs (a, b) into the true ones. All
    candidate pairs are decided, in two steps so that a group of near copies
    does not cost all its pairs:

    1. every row against two of its key's nodes (linear): the smallest, and
       the one with the largest column ``central``, or the largest node,
    2. every two rows of a key whose nodes step 1 has left in different
       components. A key whose rows are all in one component drops out.

    ``enough(l, r)`` is the number of keys that a true pair shares at least
    (1 unless given), ``alone`` the number that a node shares at least with
    any partner; pairs that share fewer are not verified.
    ``closer`` is a table (node, ...) and a test on its columns, which the second
    step applies to pairs that pass ``near``. ``once`` is a column of the rows with
    a key and a test on it that each pair passes at one of its keys at least.
    ``few_keys`` says that the number of different keys is bounded, so that
    tables by key may be broadcast.
    """
    columns = ["node", *carry]
    sent = F.broadcast if few_keys else lambda df: df

    def pairs_of(met: DataFrame, left: str, right: str, a: str, b: str) -> DataFrame:
        pair = met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.expr(enough(left, right) if enough else "1").alias("needed"))
        if not enough:
            return pair.select("a", "b").distinct()
        return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("needed").alias("needed")).where("c >= needed").select("a", "b")

    keyed = expand(nodes).select("key", *columns, *([central] if central else []))
    top = F.max_by("node", F.struct(central, "node")) if central else F.max("node")
    ends = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), top.alias("top")).where("lo <> hi")
    sides = ends.select("key", F.explode(F.array_distinct(F.array("lo", "top"))).alias("centre"))
    # The ends' own columns, looked up once for each.
    carried = nodes.select(F.col("node").alias("centre"), *[F.col(c).alias(f"r_{c}") for c in carry]).dropDuplicates(["centre"])
    sides = stage(sides.join(carried, "centre"), "star-centres")
    stars = keyed.join(sent(sides), "key").where(f"node <> centre AND ({near('', 'r_')})")
    # Keys of other centres do not count here, so a pair may be missed; the second step has it then.
    stars = stage(pairs_of(stars, "", "r_", "node", "centre"), "star-pairs")
    if stars.isEmpty():
        comp = stars.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        edges = stars
    else:
        edges = stage(verify(stars), "star-edges")
        comp = stage(components(edges), "star-comps")

    nodes = nodes.drop(central) if central else nodes
    known = stage(nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "nodes-comps")
    keyed = expand(known).select("key", "comp", *columns, *([once[0]] if once else []))
    mixed = keyed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    open_keys = stage(mixed, "keys-open")
    open_rows = keyed.join(sent(open_keys), "key", "left_semi")
    first = f"{once[1]('l.', 'r.')} AND " if once else ""
    test = f"{first}l.node < r.node AND l.comp <> r.comp AND ({near('l.', 'r.')})"
    if closer:
        more, within = closer
        # Only rows of keys that are still open carry its columns.
        open_rows = open_rows.join(more, "node")
        test += f" AND ({within('l.', 'r.')})"
    if enough:
        open_rows = open_rows_staged = stage(open_rows, "rows-open")
        # A node's own keys, of which it has a bounded number.
        lists = open_rows.groupBy("node").agg(F.collect_set("key").alias("keys"))
        # With them each pair is made at one key only, and only if it shares enough.
        open_rows = open_rows.join(lists, "node").where(f"size(keys) >= {alone or 1}")
        need = enough("l.", "r.")
        test += f" AND least(size(l.keys), size(r.keys)) >= {need} AND size(array_intersect(l.keys, r.keys)) >= {need}"
        test += " AND array_min(array_intersect(l.keys, r.keys)) = l.key"
    both = open_rows.alias("l").join(open_rows.alias("r"), (F.col("l.key") == F.col("r.key")) & F.expr(test))
    rest = both.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    rest = stage(rest.join(stars, ["a", "b"], "left_anti"), "rest-pairs")
    release(sides, known, open_keys, *([open_rows_staged] if enough else []))
    if rest.isEmpty():
        return comp
    more = stage(verify(rest), "rest-edges")
    release(rest)
    return comp if more.isEmpty() else components(edges.unionByName(more))
