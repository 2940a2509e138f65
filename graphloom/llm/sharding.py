"""Sharding by balanced label propagation, in DataFrame operations only.

Every document starts in the shard of its own hash. In each round linked
documents look at the shards their neighbours are in and move to the most
common one, as far as the shards' quotas let them; documents without links
fill what is left. At the end the shards' row counts differ by at most one
(the ``rows`` law) and each row has a gapless slot.

Links come as groups: a group's table of members per shard says what every
member's neighbours say, so a large group needs no pairs. Documents of equal
text are a group; a link between two documents is a group of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stage
from .ranks import ranked

ROUNDS = 12
#: A group over this share of a shard's quota is moved member by member, others as a whole.
SPLIT_SHARE = 1 / 64
#: Groups of up to so many rows are always moved as a whole.
FEW = 16
#: A shard with less than this share of its quota free takes nobody in until the quotas are made exact.
FULL_SHARE = 1 / 32
_GRAIN = 1 << 20


def _by_shard(values: list, shard: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), shard + 1)


def _counts(df: DataFrame, shard: str) -> dict[int, int]:
    """Rows by shard: as many numbers as there are shards."""
    return {r[0]: r[1] for r in df.groupBy(shard).agg(F.count(F.lit(1))).collect()}


def _propagate(state: DataFrame, groups: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """Rounds of label propagation over ``state`` (key, lead, degree, whole, shard) and ``groups`` (key, gid); stays within ``quota`` by expectation.

    ``lead`` is one of a row's groups: it breaks ties, and where ``whole`` is
    true its members are let in together. A row of one group counts itself,
    so that all members see the same and meet; a row of several, of which
    ``degree`` is the number, looks at the others only, and half of these
    rows wait each round, so that neighbours do not change places for ever.
    """
    for k in range(rounds):
        # Tables are written before a join that a large group makes uneven, so that it can be split.
        hist = groups.join(state, "key").groupBy("gid", "shard").agg(F.count(F.lit(1)).alias("here"))
        hist = stage(hist.withColumnRenamed("shard", "to"), "shard-hist")
        votes = groups.join(hist, "gid").groupBy("key", "to").agg(F.sum("here").alias("here"))
        load = _counts(state, "shard")
        # A shard that is full, or nearly so, draws nobody in; its members may leave it.
        room = [quota - load.get(s, 0) for s in range(shards)]
        room = [x if x > quota * FULL_SHARE else 0 for x in room]
        itself = F.when((F.col("degree") > 1) & (F.col("to") == F.col("shard")), F.col("degree")).otherwise(0)
        asked = votes.join(state, "key").withColumn("here", F.col("here") - itself).where((F.col("to") == F.col("shard")) | _by_shard([x > 0 for x in room], F.col("to"), "boolean"))
        wish = F.max_by("to", F.struct("here", F.xxhash64("lead", "to"))).alias("wish")
        wanted = stage(asked.groupBy("key", "lead", "degree", "whole", "shard").agg(wish), "shard-wanted")
        demand = _counts(wanted.where("shard <> wish"), "wish")
        accept = [min(1.0, room[s] / demand[s]) if s in demand else 0.0 for s in range(shards)]
        draw = F.pmod(F.xxhash64(F.when(F.col("whole"), F.col("lead")).otherwise(F.col("key")), F.lit(k)), F.lit(_GRAIN))
        let_in = draw < _by_shard([int(a * _GRAIN) for a in accept], F.col("wish"), "int")
        let_in = let_in & ((F.col("degree") == 1) | (F.xxhash64("key", F.lit(~k)) % 2 == 0))
        moved = wanted.select("key", "lead", "degree", "whole", F.when(let_in, F.col("wish")).otherwise(F.col("shard")).alias("shard"))
        old, state = state, stage(moved, "shard-state")
        release(hist, wanted, old)
        if not demand:
            break
    return state


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS, links: DataFrame | None = None) -> DataFrame:
    """Put every document into one of ``shards`` shards, linked ones together where quotas allow.

    ``links`` has pairs of ids (a, b); without it, documents of equal text
    are linked. Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law
    (``rows``), shard, slot (gapless from 0 in each shard) and grown_shard
    (null under this law). Row counts of two shards differ by at most one.

    Reads ``doc_id`` and ``text``, so other columns may have any name. A null
    text has size 1 and crc32 0 and is grouped with the empty text; of a very
    long one only sizes and hashes are kept. Null ids are allowed; no pair
    names them. Repeated rows are separate rows in slots of their own, and
    all rows of an id have its links. Ties go by hash. An empty table gives
    an empty one. A group larger than a shard is split.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("key"),
        ),
        "shard-rows",
    )
    total = rows.count()
    quota = -(-total // shards)
    if links is None:
        groups = rows.select("key", F.xxhash64("h", "size", "text_crc32").alias("gid"))
    else:
        pairs = links.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        ends = pairs.select(F.xxhash64("a", "b").alias("gid"), F.explode(F.array("a", "b")).alias("doc_id"))
        groups = rows.select("key", "doc_id").join(ends, "doc_id").select("key", "gid")
    several = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = stage(groups.join(stage(several, "shard-groups"), "gid"), "shard-members")
    most = max(FEW, int(quota * SPLIT_SHARE))
    leads = groups.groupBy("key").agg(F.min("gid").alias("lead"), F.count(F.lit(1)).alias("degree"), (F.max("members") <= most).alias("whole"))
    start = F.pmod(F.xxhash64("doc_id", "h", "size"), F.lit(shards)).cast("int").alias("shard")
    state = stage(rows.join(leads, "key").select("key", "lead", "degree", "whole", start), "shard-start")
    state = _propagate(state, groups.select("key", "gid"), shards, quota, rounds)
    # Rows that are moved together have adjacent ranks, so an overfull shard sheds few groups; others are dealt one by one.
    near = F.when(F.col("whole"), F.col("lead")).otherwise(F.col("key"))
    linked = rows.join(state, "key").withColumn("near", near)
    aims = [total // shards + (s < total % shards) for s in range(shards)]
    aim = _by_shard(aims, F.col("shard"), "long")
    columns = ["doc_id", "size", "text_crc32", "near", "key"]
    placed = stage(ranked(linked.select(*columns, "shard"), "shard", F.xxhash64("near", F.lit(7)), ["near", "key"], "slot", shards), "shard-ranked")
    stays = placed.where(F.col("slot") < aim)
    spilled = placed.where(F.col("slot") >= aim).select(columns)
    singles = rows.join(state, "key", "left_anti").withColumn("near", F.col("key")).select(columns)
    have = _counts(stays, "shard")
    filling = ranked(spilled.unionByName(singles).withColumn("one", F.lit(0)), "one", F.xxhash64("near", F.lit(11)), ["near", "key"], "rank", 1)
    shard, slot, first = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        free = aims[s] - have.get(s, 0)
        here = (F.col("rank") >= first) & (F.col("rank") < first + free)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("rank") - first + have.get(s, 0)).otherwise(slot)
        first += free
    filled = filling.select("doc_id", "size", "text_crc32", shard.alias("shard"), slot.alias("slot"))
    out = stays.select("doc_id", "size", "text_crc32", "shard", "slot").unionByName(filled)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
