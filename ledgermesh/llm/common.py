"""Helpers shared by the operators of this package.

Row identity: operators identify a row by ``(doc_id, xxhash64(text))``. Both
come from the row itself, so a recomputed task yields the same keys, null and
repeated ids work, and rows equal in both are the same document.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.session import ensure_checkpoint_dir


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if _staged:
        _staged[-1].append(out)
    return out


#: Tables staged by the calls of ``tidied`` that run, innermost last.
_staged: list[list[DataFrame]] = []


def tidied(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, staged; the tables that it staged on its way are
    deleted."""
    _staged.append([])
    try:
        result = build()
        on_the_way = list(_staged[-1])
        out = staged(result, name)
        discard(*on_the_way)
    finally:
        _staged.pop()
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does the same on pure ASCII, faster."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string or binary
    array, without copying; null rows are empty."""
    import pyarrow as pa
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset:array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if array.null_count:
        valid = np.asarray(array.is_valid())
        if (np.diff(at)[~valid] != 0).any():  # a null slot may cover bytes
            array = pa.array(["" if v is None else v for v in array.to_pylist()], array.type)
            return utf8(array)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges of at most ``limit`` bytes each, one row at least, so that
    work arrays stay small whatever the batch size."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
