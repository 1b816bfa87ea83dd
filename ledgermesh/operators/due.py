"""Due calendar (JN-1): when each undecided ref needs its next match run.

Entries ``transaction_ref, kind, due_at, slot`` are written with the state and
partitioned by ``slot`` (the hour of ``due_at``), so a run finds its due refs in
the slots up to now and never scans the record history. An entry only says where to
look: the state decides whether a ref is due, so entries that later runs made
obsolete do no harm, and a slot that lies wholly in the past can be dropped once
a run has read it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ledgermesh.functions.times import add_seconds, as_ts
from ledgermesh.operators.matching import PENDING, REF

DUE_SCHEMA = "transaction_ref string, kind string, due_at timestamp_ntz"
SLOT_SECS = 3600
RETRY, TIMEOUT = "retry", "timeout"


def slot_of(due_at: Column) -> Column:
    return F.floor(F.unix_seconds(due_at.cast("timestamp")) / SLOT_SECS).cast("int")


def slot_at(as_of: dt.datetime) -> int:
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return int((as_of - dt.datetime(1970, 1, 1)).total_seconds() // SLOT_SECS)


def _entries(refs: DataFrame, kind: str, due_at: Column) -> DataFrame:
    return refs.select(REF, F.lit(kind).alias("kind"), due_at.alias("due_at")).withColumn("slot", slot_of(F.col("due_at")))


def retry_entries(state: DataFrame, backoff_secs: int) -> DataFrame:
    """One per PENDING ref with retries left: its last run plus the back-off."""
    waiting = state.filter((F.col("status") == PENDING) & (F.col("retry_count") < F.col("max_retries")))
    return _entries(waiting, RETRY, add_seconds(F.col("last_processed_at"), F.lit(int(backoff_secs))))


def timeout_entries(records: DataFrame, pending_timeout_secs: int) -> DataFrame:
    """One per ref of these records: its first record plus the pending timeout."""
    first = records.groupBy(REF).agg(F.min("server_received_at").alias("first"))
    return _entries(first, TIMEOUT, add_seconds(F.col("first"), F.lit(int(pending_timeout_secs))))


def again_entries(refs: DataFrame, as_of) -> DataFrame:
    """Refs to run again at the next run (their amounts did not parse)."""
    return _entries(refs, RETRY, as_ts(as_of))


def due_now(calendar: DataFrame, as_of) -> DataFrame:
    """Entries whose time has come; with ``calendar`` partitioned by slot, later
    slots are pruned."""
    return calendar.filter((F.col("slot") <= slot_at(as_of)) & (F.col("due_at") <= as_ts(as_of)))
