"""SimHash and multi-index Hamming blocks, in DataFrame operations only.

Fingerprints have 63 bits. Bits of a group of hashes are counted in sums of
longs: 63 / lane bits, ``lane`` places apart, share a long in lanes of that
many bits, so that lanes of 21 bits take 21 sums for groups of up to a
million hashes, and lanes of 9 bits take 9 for groups of up to 255.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 63
WIDE, NARROW = 21, 9


def _ones(lane: int) -> int:
    """One in each lane."""
    return sum(1 << k * lane for k in range(BITS // lane))


def most(lane: int) -> int:
    """Hashes that a group can have, at most: half a lane, so that majorities show in its top bit."""
    return (1 << lane - 1) - 1


#: For lanes of the usual width.
MOST = most(WIDE)

#: Cost of a row that is keyed, shuffled and sorted, in candidate pairs tested.
_ROW_COST = 100


def lane_sums(h: Column, lane: int = WIDE) -> list[Column]:
    """Aggregates ``lane0`` ... over the hash ``h`` of each feature."""
    ones = F.lit(_ones(lane))
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(ones)).alias(f"lane{j}") for j in range(lane)]


def fingerprint(n: Column, lane: int = WIDE) -> Column:
    """The fingerprint from ``lane0`` ... of a group of ``n`` hashes: bits that over half of them have."""
    # Lifts every lane that has more than n / 2 to its top bit.
    lift = (F.lit(most(lane)) - F.shiftright(n.cast("long"), 1)) * F.lit(_ones(lane))
    top = F.lit(_ones(lane) << lane - 1)
    out = None
    for j in range(lane):
        bits = F.shiftright((F.col(f"lane{j}") + lift).bitwiseAND(top), lane - 1 - j)
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def bit_counts(lane: int) -> list[Column]:
    """Aggregates ``bit0`` ... over several groups' ``lane0`` ...: how many hashes of all have each bit."""
    mask = F.lit((1 << lane) - 1).cast("long")
    return [F.sum(F.shiftrightunsigned(F.col(f"lane{b % lane}"), b - b % lane).bitwiseAND(mask)).alias(f"bit{b}") for b in range(BITS)]


def fingerprint_of_counts(n: Column) -> Column:
    """The fingerprint from ``bit0`` ... of ``n`` hashes, however many."""
    out = F.lit(0).cast("long")
    for b in range(BITS):
        out = out.bitwiseOR(F.when(F.col(f"bit{b}") * 2 > n, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def plan(rows: int, radius: int) -> tuple[int, int]:
    """Blocks of a fingerprint and how many of them must agree, the cheapest for so many rows.

    With radius + agree blocks, any two fingerprints within the radius agree
    on at least ``agree`` of them, so every plan finds the same pairs. More
    agreeing blocks make more rows and fewer chance candidates.
    """
    best = None
    for agree in (1, 2, 3):
        blocks = radius + agree
        tables = math.comb(blocks, agree)
        chance = tables * rows * rows / 2.0 ** (BITS // blocks * agree)
        cost = _ROW_COST * tables * rows + chance
        if best is None or cost < best[0]:
            best = (cost, blocks, agree)
    return best[1], best[2]


def block_keys(sim: Column, blocks: int, agree: int) -> Column:
    """An array of longs: for each choice of ``agree`` blocks its number and the blocks' bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def joined(chosen: Sequence[int], number: int) -> Column:
        key, used = F.lit(number).cast("long"), 0
        for b in chosen:
            width = edges[b + 1] - edges[b]
            part = F.shiftrightunsigned(sim, edges[b]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key, used = F.shiftleft(key, width).bitwiseOR(part), used + width
        return key

    return F.array(*[joined(c, i + 1) for i, c in enumerate(combinations(range(blocks), agree))])


def key_space(blocks: int, agree: int) -> int:
    """Different keys that ``block_keys`` can make, at most."""
    return math.comb(blocks, agree) << (-(-BITS // blocks) * agree)
