"""Time expressions. All timestamps are TIMESTAMP_NTZ holding UTC wall time."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F

# Accepted event-time layouts, tried in this order.
EVENT_TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX",  # RFC 3339 / RFC 3339 with nanos
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
)


def as_ts(value) -> Column:
    """A literal or column as TIMESTAMP_NTZ (UTC wall time)."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def parse_event_time(text: Column) -> Column:
    """First layout that parses, converted to UTC wall time; NULL otherwise.

    Zoned layouts parse to an instant; the session time zone is UTC, so the
    cast to TIMESTAMP_NTZ yields UTC wall time.
    """
    zoned = F.try_to_timestamp(text, F.lit(EVENT_TIME_FORMATS[0])).cast("timestamp_ntz")
    plain = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in EVENT_TIME_FORMATS[1:]]
    return F.coalesce(zoned, *plain)


def unix_millis_ntz(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def age_seconds(as_of: Column, since: Column) -> Column:
    """Whole seconds from ``since`` to ``as_of``, floored at 0."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.greatest(F.floor(micros / F.lit(1_000_000)).cast("long"), F.lit(0).cast("long"))


def add_seconds(ts: Column, secs: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))


def backoff_seconds(attempt: Column, base_secs: int = 60, max_secs: int = 3600) -> Column:
    """``min(base * 2^(attempt-1), max)`` whole seconds (RT-2)."""
    raw = F.lit(float(base_secs)) * F.pow(F.lit(2.0), attempt.cast("double") - F.lit(1.0))
    return F.least(raw, F.lit(float(max_secs))).cast("long")
