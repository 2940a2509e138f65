"""Numbers along a total order, without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.staging import stage

#: Bits of ``monotonically_increasing_id`` that count within a partition.
_WITHIN = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rows' places (from 1) in ``order`` as column ``name``.

    Rows are sorted by ranges and written; each range's first number follows
    from the sizes of those before it, a row for each range.
    """
    place = "__place"
    rows = stage(df.orderBy(*order).withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(place, _WITHIN)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__start")))
    within = F.col(place).bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return rows.join(starts, part == F.col("__part")).select((F.col("__start") + within + 1).cast("int").alias(name), *df.columns)
