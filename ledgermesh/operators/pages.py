"""Listings laid out for paging and lookups (LM-2, LM-3, JN-5).

``write_listing`` sorts a listing by its key into chunks (range partitions) and stores
each chunk's first and last key and size beside it. A page or a lookup reads that
small table, then only the chunks that can hold its rows: a page of a listing of
any length reads one chunk, two where it crosses a border.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_listing(df: DataFrame, path: str, by: list[str], rows_per_chunk: int = 1_000_000) -> None:
    """``by`` is the listing's order; nulls come first. The listing is written as it
    is: filter it first (a page of MISMATCHED refs comes from a listing of them)."""
    n = max(1, -(-df.count() // rows_per_chunk))
    (df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("chunk", F.spark_partition_id())
     .write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/rows"))
    df.limit(0).write.mode("overwrite").parquet(f"{path}/schema")  # what an empty listing looks like
    key = F.struct(*by)
    (df.sparkSession.read.schema(f"{_ddl(df)}, chunk int").parquet(f"{path}/rows").groupBy("chunk")
     .agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _chunks(spark: SparkSession, path: str, chunks: list[int]) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema")
    if not chunks:
        return schema
    # the folders are named, so no others are listed
    return spark.read.schema(f"{_ddl(schema)}, chunk int").option("basePath", f"{path}/rows").parquet(
        *[f"{path}/rows/chunk={c}" for c in chunks]).drop("chunk")


def _key(values: dict) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


def read_page(spark: SparkSession, path: str, size: int, after: dict | None = None) -> DataFrame:
    """The next ``size`` rows in the listing's order after the key ``after`` (column:
    value, in that order), from the start without one."""
    ranges = spark.read.parquet(f"{path}/ranges")
    if after is not None:
        ranges = ranges.filter(F.col("last") > _key(after))
    by = [f.name for f in ranges.schema["first"].dataType.fields]
    wanted, rest = [], size
    # the first chunk may hold nothing after the key, all others hold a row at least
    for k, r in enumerate(ranges.orderBy("first").limit(size + 1).collect()):
        wanted.append(r.chunk)
        rest -= 0 if k == 0 and after is not None else r.rows
        if rest <= 0:
            break
    rows = _chunks(spark, path, wanted)
    if after is not None:
        rows = rows.filter(F.struct(*by) > _key(after))
    return rows.orderBy(*by).limit(size)


def look_up(spark: SparkSession, path: str, keys: list[dict]) -> DataFrame:
    """The listing's rows of a stated list of keys."""
    if not keys:
        return _chunks(spark, path, [])
    ranges = spark.read.parquet(f"{path}/ranges")
    held = reduce(Column.__or__, [(F.col("first") <= _key(k)) & (F.col("last") >= _key(k)) for k in keys])
    chunks = [r.chunk for r in ranges.filter(held).select("chunk").collect()]  # two a key at most, where keys are unique
    same = reduce(Column.__or__, [reduce(Column.__and__, [F.col(c) == v for c, v in k.items()]) for k in keys])
    return _chunks(spark, path, chunks).filter(same)
