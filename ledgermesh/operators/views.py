"""Listings and pages (JN-2, JN-3, LM-2, LM-5, LM-6, RT-5).

Pages are keyset filters + ``orderBy().limit()`` (TakeOrderedAndProject: each
task keeps its top rows, the driver merges at most ``size`` per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgermesh.operators.matching import MISMATCHED, REF


def page_size(size: int | None, max_size: int = 100, default: int = 20) -> int:
    """LM-2 size rule: 1..max else the default (D15: over max is the default)."""
    return size if size is not None and 1 <= size <= max_size else default


def list_mismatches(state: DataFrame, details: DataFrame, source_filter: str | None = None,
                    size: int | None = None, after: str | None = None) -> DataFrame:
    """JN-2 + LM-2: MISMATCHED refs (optionally only those with a detail row
    of ``source_filter``), ordered by ref, keyset ``ref > after``."""
    s = state.filter(F.col("status") == MISMATCHED)
    if source_filter:
        s = s.join(details.filter(F.col("system_name") == source_filter).select(REF), REF, "left_semi")
    if after:
        s = s.filter(F.col(REF) > F.lit(after))
    return s.orderBy(REF).limit(page_size(size))


def next_page_token(page: DataFrame) -> DataFrame:
    """LM-2: the last ref of a page is the next token."""
    return page.agg(F.max(REF).alias("next_page_token"))


def attach_details(refs_state: DataFrame, details: DataFrame) -> DataFrame:
    """JN-3: details array per ref joined to the listed refs (one IN-fetch)."""
    d = details.join(refs_state.select(REF), REF, "left_semi")
    per = d.groupBy(REF).agg(F.array_sort(F.collect_list(F.struct(
        "system_name", "internal_id", "amount", "currency", "discrepancy_found"))).alias("details"))
    return refs_state.join(per, REF, "left")


def latest_records_of_source(records: DataFrame, source: str, n: int) -> DataFrame:
    """LM-5: newest ``n`` records of one source."""
    return (records.filter(F.col("source_system") == source)
            .orderBy(F.col("server_received_at").desc(), F.col("internal_id").desc()).limit(int(n)))


def latest_records_per_source(records: DataFrame, n: int) -> DataFrame:
    """LM-5, every source: ``row_number() <= n`` per source. Spark plans a
    map-side WindowGroupLimit, so a hot source ships only ``n`` rows per
    task to the shuffle."""
    w = Window.partitionBy("source_system").orderBy(F.col("server_received_at").desc(), F.col("internal_id").desc())
    return records.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= int(n)).drop("_rn")


def dlq_replay_batch(dlq: DataFrame, max_retries: int = 3, limit: int | None = None) -> DataFrame:
    """LM-6: DLQ rows still retryable, oldest first."""
    rows = dlq.filter(F.col("retry_count") < int(max_retries))
    return rows.orderBy("created_at", "idempotency_key").limit(int(limit)) if limit else rows


def mismatches_with_source(state: DataFrame, details: DataFrame, source: str) -> DataFrame:
    """JN-2 without paging: MISMATCHED refs that have a detail of ``source``."""
    return state.filter(F.col("status") == MISMATCHED).join(
        details.filter(F.col("system_name") == source).select(REF), REF, "left_semi")
