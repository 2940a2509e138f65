"""Embedding rows as vectors of whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component c counts as floor(SCALE * c).
SCALE = 256


def quantised(embeddings: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``x`` of the rows whose vector is there and has finite entries only: the floors of 256 times its entries, as longs.

    Only ``columns`` and ``embedding`` are read, so other columns may have any
    name. A shorter vector counts as filled up with zeros to the length of
    the longest, which costs a pass of its own; an empty table stays empty.
    """
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    kept = embeddings.select(*columns, "embedding").where(F.coalesce(finite, F.lit(False)))
    width = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long"))
    filled = F.when(F.size(x) == width, x).otherwise(F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x))))
    return kept.select(*columns, filled.alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as rows of longs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def largest(x: np.ndarray) -> int:
    """The largest absolute entry, as an unbounded number."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
