"""Append-only audit trail (T6, SNK-5, AU-1, AU-2).

Rows: ``transaction_ref, event_type, old_status, new_status, details`` (JSON
text), ``created_at``, ``batch_id`` and ``seq`` (order of events of one ref
inside one batch). Chronological order is ``(created_at, batch_id, seq)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgermesh.functions.times import as_ts
from ledgermesh.operators.matching import REF

AUDIT_SCHEMA = ("transaction_ref string, event_type string, old_status string, new_status string, "
                "details string, created_at timestamp_ntz, batch_id string, seq int")
AUDIT_COLUMNS = [f.split()[0] for f in AUDIT_SCHEMA.split(", ")]

# The audit event domain.
EVENT_TYPES = ("MATCH_ATTEMPT", "RETRIGGER", "MANUAL_RESOLUTION", "AUTO_RESOLUTION", "RETRY_ENQUEUED",
               "RETRY_ENGINE_ERROR", "RETRY_RESOLVED", "RETRY_ATTEMPT", "RETRY_EXHAUSTED")


def empty_audit(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], AUDIT_SCHEMA)


def events(df: DataFrame, event_type: str | Column, old_status: Column, new_status: Column,
           details: Column, as_of, batch_id: str, seq: int = 0) -> DataFrame:
    """Build audit rows from a DataFrame keyed by ``transaction_ref``."""
    et = F.lit(event_type) if isinstance(event_type, str) else event_type
    return df.select(REF, et.alias("event_type"), old_status.cast("string").alias("old_status"),
                     new_status.cast("string").alias("new_status"), details.cast("string").alias("details"),
                     as_ts(as_of).alias("created_at"), F.lit(batch_id).alias("batch_id"),
                     F.lit(int(seq)).alias("seq"))


def append_audit(base: DataFrame, delta: DataFrame) -> DataFrame:
    """SNK-5: append only."""
    return base.select(*AUDIT_COLUMNS).unionByName(delta.select(*AUDIT_COLUMNS))


def audit_trail(audit: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """AU-1: each ref's events in chronological order, one row per event with
    its ``ordinal``. A ref's history grows with every batch and retry, so it
    is never collected into one array; the window sorts and spills."""
    from pyspark.sql import Window
    a = audit if refs is None else audit.join(refs.select(REF).distinct(), REF, "left_semi")
    w = Window.partitionBy(REF).orderBy("created_at", "batch_id", "seq", "event_type")
    return a.withColumn("ordinal", F.row_number().over(w))


def audit_counts(audit: DataFrame) -> DataFrame:
    """AU-1: number of entries per ref (partial aggregate)."""
    return audit.groupBy(REF).agg(F.count(F.lit(1)).alias("entry_count"))


def replay_status(audit: DataFrame) -> DataFrame:
    """AU-2: last ``new_status`` per ref (must equal the state's status)."""
    order = F.struct("created_at", "batch_id", "seq")
    return (audit.filter(F.col("new_status").isNotNull())
            .groupBy(REF).agg(F.max_by("new_status", order).alias("replayed_status")))
