"""Vectors as exact integers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this squared length every inner product and squared distance of two
#: vectors, and a hundred times an inner product, is exact in 64 bits.
MAX_SQUARE = 2.0 ** 55


def finite(vector: Column) -> Column:
    """Not null, and no component is null, NaN or infinite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


def exact(vector: Column, scale: int = 256) -> Column:
    """``finite`` and short enough for 64-bit sums."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") * scale, F.lit(2.0)))
    return finite(vector) & (square < MAX_SQUARE)


def scaled(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component as a double, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column of longs, cut or padded with zeros to
    ``width`` (the longest row by default)."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    width = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    starts = np.cumsum(lengths) - lengths
    inside = np.arange(width) < lengths[:, None]
    out = np.zeros((len(lengths), width), np.int64)
    out[inside] = flat[(starts[:, None] + np.arange(width))[inside]]
    return out
