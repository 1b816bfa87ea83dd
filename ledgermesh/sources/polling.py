"""Polling as a streaming source (SRC-7, STR-5): a Python data source whose offset is
the watermark.

``spark.readStream.format("ledger_poll").option("path", ...).option("watermark", ...)``
reads a landed table (Parquet files on a file system that Arrow reaches). Every
trigger is a poll: its end offset is the greatest watermark value in the files'
statistics, its rows are those after the last poll's offset, and Spark's checkpoint keeps
the offset, so a restart goes on where it stopped and gives each row once. Row groups
outside the range are not read; each file with rows in range is a task of its own.

Rows must land in the order of the watermark, as in any poll: one that lands later with
an older value is missed. Rows without a watermark value are never due. Options:
``path``, ``watermark`` (column, default ``updated_at``), ``since`` (first offset, ISO time;
default 24 hours before the first poll), ``columns`` (comma-separated, default all).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ledgermesh.sources.database import FIRST_POLL_LOOKBACK


def _filesystem(path: str):
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _dataset(path: str):
    import pyarrow.dataset as ds
    filesystem, root = _filesystem(path)
    return ds.dataset(root, filesystem=filesystem, format="parquet")


def _iso(value) -> str:
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value.isoformat(timespec="microseconds")


class _File(InputPartition):
    def __init__(self, name: str, after: str, upto: str):
        self.name, self.after, self.upto = name, after, upto


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.path, self.column = options["path"], options.get("watermark", "updated_at")
        self.since = options.get("since")
        self.names = [f.name for f in schema.fields]

    def _bounds(self, fragment) -> tuple[str, str] | None:
        """Least and greatest watermark of a file, from its footer."""
        k = fragment.physical_schema.get_field_index(self.column)
        low = high = None
        meta = fragment.metadata
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(k).statistics
            if stats is not None and stats.has_min_max:
                low = stats.min if low is None else min(low, stats.min)
                high = stats.max if high is None else max(high, stats.max)
        return None if low is None else (_iso(low), _iso(high))

    def initialOffset(self) -> dict:
        first = self.since or _iso(dt.datetime.now(dt.timezone.utc) - FIRST_POLL_LOOKBACK)
        return {"watermark": _iso(dt.datetime.fromisoformat(first))}

    def latestOffset(self) -> dict:
        found = [b[1] for b in map(self._bounds, _dataset(self.path).get_fragments()) if b]
        return {"watermark": max([self.initialOffset()["watermark"], *found])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for fragment in _dataset(self.path).get_fragments():
            bounds = self._bounds(fragment)
            if bounds and bounds[1] > start["watermark"] and bounds[0] <= end["watermark"]:
                out.append(_File(fragment.path, start["watermark"], end["watermark"]))
        return out

    def read(self, partition: _File):
        import pyarrow as pa
        import pyarrow.dataset as ds
        filesystem, _ = _filesystem(self.path)
        table = ds.dataset(partition.name, filesystem=filesystem, format="parquet")
        kind = table.schema.field(self.column).type
        at = lambda text: pa.scalar(dt.datetime.fromisoformat(text).replace(
            tzinfo=dt.timezone.utc if kind.tz else None)).cast(kind)
        due = (ds.field(self.column) > at(partition.after)) & (ds.field(self.column) <= at(partition.upto))
        yield from table.to_batches(columns=self.names, filter=due)

    def commit(self, end: dict) -> None:
        pass


class PollingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger_poll"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema
        schema = _dataset(self.options["path"]).schema
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if wanted:
            import pyarrow as pa
            schema = pa.schema([schema.field(c) for c in wanted])
        return from_arrow_schema(schema, prefer_timestamp_ntz=True)

    def streamReader(self, schema):
        return _Reader(self.options, schema)


def register_polling(spark) -> None:
    """Make the format ``ledger_poll`` known to a session."""
    spark.dataSource.register(PollingSource)
