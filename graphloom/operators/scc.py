"""Strongly connected components, and the cycles they stand for.

Most of a dependency graph lies on paths without a choice: nodes with one
edge out (or, seen backwards, one edge in). Following these is a function, so
pointers that double their reach find where each such path ends in rounds
that grow with the logarithm of its length. A path that ends in itself is a
component; any other is drawn together into its end, and told apart again
afterwards. What stays has a choice everywhere, in both directions; there
colours spread until they settle. Every round is a join whose result is
written; no task holds more than its share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.numbering import numbered
from graphloom.staging import stage

#: Paths are drawn together while one node in so many edges lies on one.
WORTH = 20
#: Steps of colouring after which the search gives up rather than return something wrong.
MAX_STEPS = 10_000
TRIM_STEPS = 8
#: Members of a chunk in the table of members.
CHUNK_MEMBERS = 10_000


@dataclass
class _Drawn:
    """Nodes ``v`` drawn together into the ends ``r`` of their paths; ``jumps`` (v, to) reach 1, 4, 16, ... nodes far; ``entries`` (y, u) lead from other nodes into paths."""

    ends: DataFrame
    jumps: list[DataFrame]
    entries: DataFrame


def _without_ends(links: DataFrame) -> DataFrame:
    """Edges between nodes that have an edge in, or out, as well: others are components by themselves."""
    kept = links.join(links.select(F.col("t").alias("s")).distinct(), "s", "left_semi")
    return kept.join(links.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t")


def _doubled(jump: DataFrame) -> DataFrame:
    """Pointers of twice the reach; ``low`` is the smallest of the nodes passed, ``moved`` says that a pointer went on."""
    far = jump.select(F.col("v").alias("to"), F.col("to").alias("then"), F.col("low").alias("then_low"))
    return jump.join(far, "to", "left").select("v", F.coalesce("then", "to").alias("to"), F.least("low", "then_low").alias("low"), F.col("then").isNotNull().alias("moved"))


def _draw_together(links: DataFrame) -> tuple[_Drawn | None, DataFrame | None, DataFrame] | None:
    """Follow nodes with a single edge out: what was drawn together, components ``(key, label)`` found on the way, and the edges that stay.

    None where too few nodes have a single edge.
    """
    outs = stage(links.groupBy("s").agg(F.min("t").alias("to"), F.count(F.lit(1)).alias("n")), "scc-outs")
    sources, many, edges = outs.agg(F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.coalesce(F.sum("n"), F.lit(0))).first()
    if many * WORTH < edges:
        return None
    jump = outs.where("n = 1").select(F.col("s").alias("v"), "to", F.col("s").alias("low"))
    nodes, jumps, reach, moved = jump.select("v"), [jump], 1, True
    while moved and reach < many:
        # Two doublings to a written table.
        jump = stage(_doubled(_doubled(jump).drop("moved")), "scc-jumps")
        moved, reach = not jump.where("moved").isEmpty(), reach * 4
        jumps.append(jump)
    # A pointer that still stands on such a path after as many steps as there are nodes is on a cycle of them.
    known = jump.join(nodes.select(F.col("v").alias("to"), F.lit(True).alias("again")), "to", "left")
    known = stage(known.select("v", "to", "low", F.coalesce("again", F.lit(False)).alias("looped")), "scc-paths")
    looped, ends = known.where("looped"), known.where("NOT looped").select("v", F.col("to").alias("r"))
    found = looped.join(looped.select(F.col("to").alias("v")).distinct(), "v", "left_semi").select(F.col("v").alias("key"), F.col("low").alias("label")) if moved else None
    if many == sources:
        # Every edge starts on a path: what does not loop ends.
        return None, found, links.where("false")
    others = links.join(nodes.toDF("s"), "s", "left_anti")
    entries = stage(others.join(ends.select(F.col("v").alias("t")), "t", "left_semi").select(F.col("s").alias("y"), F.col("t").alias("u")), "scc-entries")
    rest = others.join(looped.select(F.col("v").alias("t")), "t", "left_anti").join(ends.select(F.col("v").alias("t"), "r"), "t", "left")
    rest = rest.select("s", F.coalesce("r", "t").alias("t")).where("s <> t").distinct()
    return _Drawn(ends, jumps, entries), found, stage(_without_ends(stage(rest, "scc-links")), "scc-links")


def _told_apart(drawn: _Drawn, found: DataFrame) -> DataFrame:
    """``found`` (key, label) with the drawn nodes that belong to the component of their path's end.

    Those are the nodes that the end reaches: where a path is entered from
    the end's component, and all that follows on it.
    """
    label = lambda c: found.select(F.col("key").alias(c), F.col("label").alias(f"{c}_label"))
    met = drawn.entries.join(drawn.ends.select(F.col("v").alias("u"), "r"), "u").join(label("y"), "y", "left").join(label("r"), "r", "left")
    inside = stage(met.where("coalesce(y_label, y) = coalesce(r_label, r)").select(F.col("u").alias("v")).distinct(), "scc-inside")
    if inside.isEmpty():
        return found
    for jump in drawn.jumps:
        # Up to three jumps of one reach, then the next.
        for _ in range(2):
            step = jump.select("v", "to")
            inside = inside.union(inside.join(step, "v").select("to")).distinct()
        inside = stage(inside.union(inside.join(step, "v").select("to")).distinct(), "scc-inside")
    kept = drawn.ends.join(inside, "v", "left_semi").join(label("r"), "r", "left")
    return stage(found.unionByName(kept.select(F.col("v").alias("key"), F.coalesce("r_label", "r").alias("label"))), "scc-found")


def _spread(colour: DataFrame, links: DataFrame) -> DataFrame:
    """``colour`` (k, c, old) after each node has taken the largest colour that an edge brings it."""
    sent = links.join(colour.select(F.col("k").alias("s"), "c"), "s").groupBy(F.col("t").alias("k")).agg(F.max("c").alias("m"))
    return colour.join(sent, "k", "left").select("k", F.greatest("c", "m").alias("c"), "old")


def _coloured(links: DataFrame) -> DataFrame | None:
    """By colours: the largest node that reaches a node colours it; what reaches back to the colour's node in its colour is a component."""
    done = None
    steps = 0

    def tick() -> None:
        nonlocal steps
        steps += 1
        if steps > MAX_STEPS:
            raise RuntimeError("components did not settle")

    while not links.isEmpty():
        for _ in range(TRIM_STEPS):
            tick()
            kept = stage(_without_ends(links), "scc-links")
            same = kept.count() == links.count()
            links = kept
            if same:
                break
        if links.isEmpty():
            break
        nodes = links.select(F.col("s").alias("k")).union(links.select("t")).distinct()
        colour = stage(nodes.withColumn("c", F.col("k")), "scc-colours")
        while True:
            tick()
            # Two steps to a written table.
            new = stage(_spread(_spread(colour.withColumn("old", F.col("c")), links), links).withColumn("moved", F.col("c") > F.col("old")), "scc-colours")
            colour = new.select("k", "c")
            if new.where("moved").isEmpty():
                break
        inside = links.join(colour.toDF("s", "c"), "s").join(colour.toDF("t", "d"), "t").where("c = d").select("s", "t", "c")
        inside = stage(inside, "scc-inside")
        reached = stage(colour.where("k = c").withColumn("fresh", F.lit(True)), "scc-reached")
        while not reached.where("fresh").isEmpty():
            tick()
            back = inside.join(reached.where("fresh").select(F.col("k").alias("t"), F.col("c").alias("fc")), "t").where("c = fc").select(F.col("s").alias("k"), "c").distinct()
            back = back.join(reached.select("k"), "k", "left_anti").withColumn("fresh", F.lit(True))
            reached = stage(reached.withColumn("fresh", F.lit(False)).unionByName(back), "scc-reached")
        part = reached.select(F.col("k").alias("key"), F.col("c").alias("label"))
        done = part if done is None else done.unionByName(part)
        gone = reached.select("k")
        links = links.join(gone.toDF("s"), "s", "left_anti").join(gone.toDF("t"), "t", "left_anti")
        links = stage(links, "scc-links")
    return done


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(key, scc_id)`` of every node and edge end; ``scc_id`` is the component's smallest key."""
    every = nodes.select("key").union(edges.select("source_key")).union(edges.select("target_key")).distinct()
    links = stage(edges.select(F.col("source_key").alias("s"), F.col("target_key").alias("t")).where("s <> t").distinct(), "scc-links")
    drawn: list[_Drawn] = []
    found: DataFrame | None = None
    idle = 0
    while idle < 2 and not links.isEmpty():
        got = _draw_together(links)
        idle = idle + 1 if got is None else 0
        if got is not None:
            drawn += [got[0]] if got[0] else []
            found = got[1] if found is None else found if got[1] is None else found.unionByName(got[1])
            links = got[2]
        # Backwards, single edges in are single edges out, and components are the same.
        links = links.select(F.col("t").alias("s"), F.col("s").alias("t"))
    rest = _coloured(links)
    found = rest if found is None else found if rest is None else found.unionByName(rest)
    if found is None:
        found = every.select("key", F.col("key").alias("label")).where("false")
    for step in reversed(drawn):
        found = _told_apart(step, found)
    known = stage(every.join(found, "key", "left").select("key", F.coalesce("label", "key").alias("label")), "scc-labels")
    names = known.groupBy("label").agg(F.min("key").alias("scc_id"))
    return known.join(names, "label").select("key", "scc_id")


def cyclic_components(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """``(scc_id, size)`` of components of two or more nodes, or of one with an edge to itself."""
    loops = edges.where("source_key = target_key").select(F.col("source_key").alias("key"), F.lit(1).alias("loop")).distinct()
    sizes = scc.join(loops, "key", "left").groupBy("scc_id").agg(F.count(F.lit(1)).alias("size"), F.max("loop").alias("loop"))
    return sizes.where("size > 1 OR loop = 1").select("scc_id", "size")


def cycle_nodes(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """``(key, scc_id)`` of nodes in a cycle."""
    return scc.join(cyclic_components(scc, edges).select("scc_id"), "scc_id", "left_semi").select("key", "scc_id")


def cycle_edges(cyclic: DataFrame, edges: DataFrame) -> DataFrame:
    """``(source_key, target_key)`` of edges inside one cyclic component."""
    source, target = cyclic.toDF("source_key", "a"), cyclic.toDF("target_key", "b")
    return edges.join(source, "source_key").join(target, "target_key").where("a = b").select("source_key", "target_key")


def _named(cyclic: DataFrame, nodes: DataFrame) -> DataFrame:
    named = cyclic.join(nodes.select("key", "name"), "key", "left")
    return named.withColumn("name", F.coalesce("name", F.col("key").cast("string")))


def cycle_members(cyclic: DataFrame, nodes: DataFrame, size: int = CHUNK_MEMBERS) -> DataFrame:
    """``(scc_id, chunk, position, name)``: members of each cycle by name, from 0, ``size`` to a chunk.

    Members are numbered by ranges of all of them, so a cycle of any size is
    spread over many tasks; a reader takes the chunks it shows.
    """
    placed = numbered(_named(cyclic, nodes), [F.asc("scc_id"), F.asc("name"), F.asc("key")], "place")
    first = placed.groupBy("scc_id").agg(F.min("place").alias("first"))
    position = F.col("place") - F.col("first")
    return placed.join(first, "scc_id").select("scc_id", F.expr(f"int((place - first) div {size})").alias("chunk"), position.alias("position"), "name")


def cycles(cyclic: DataFrame, nodes: DataFrame, scope: str) -> DataFrame:
    """``(rank, scope, nodes, length, scc_id)``: longest first, then by first name. Members are sorted by name.

    A row holds the names of its cycle, as a report does; ``cycle_members``
    has them without that.
    """
    lists = _named(cyclic, nodes).groupBy("scc_id").agg(F.array_sort(F.collect_list("name")).alias("nodes"))
    sized = lists.select(F.lit(scope).alias("scope"), "nodes", F.size("nodes").alias("length"), "scc_id")
    return numbered(sized, [F.desc("length"), F.get("nodes", F.lit(0)), F.col("scc_id")], "rank")
