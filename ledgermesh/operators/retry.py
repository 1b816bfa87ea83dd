"""Retry queue (T8, RT-1..5, LM-4, AG-6, SNK-7).

The reference's retry worker loops over 50 due rows every 30 s. Here a run
takes every due row at once: due rows -> retrigger (one reconcile plan) ->
one CASE transition per row -> queue upsert, audit rows, optional
auto-resolution of the exhausted ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermesh.config import AutoResolveConfig, MatchRules, RetryPolicy
from ledgermesh.functions.times import add_seconds, as_ts, backoff_seconds
from ledgermesh.operators import audit as A
from ledgermesh.operators import resolution as RS
from ledgermesh.operators.matching import ERROR, MATCHED, MISMATCHED, PENDING, REF, RESOLVED

QUEUE_SCHEMA = ("transaction_ref string, attempt_count int, max_attempts int, last_attempted_at timestamp_ntz, "
                "next_retry_at timestamp_ntz, status string, requested_by string, created_at timestamp_ntz, "
                "updated_at timestamp_ntz")
QUEUE_COLUMNS = [f.split()[0] for f in QUEUE_SCHEMA.split(", ")]
EXHAUSTED = "EXHAUSTED"


def empty_queue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUEUE_SCHEMA)


@dataclass
class EnqueueOutcome:
    queue: DataFrame
    audit_delta: DataFrame
    rejections: DataFrame


def enqueue_retry(queue: DataFrame, refs: DataFrame, state: DataFrame, as_of, max_attempts: int = 5,
                  requested_by: str = "api", batch_id: str = "enqueue") -> EnqueueOutcome:
    """RT-1: only MISMATCHED refs. New -> PENDING, 0 attempts, due now.
    Existing: max_attempts, next_retry_at=now and requested_by replaced;
    EXHAUSTED -> PENDING with 0 attempts; other status/attempts kept."""
    now = as_ts(as_of)
    r = refs.select(REF).distinct().join(state.select(REF, F.col("status").alias("_st")), REF, "left")
    ok = r.filter(F.col("_st") == MISMATCHED).select(REF)
    rej = r.filter(~F.coalesce(F.col("_st") == MISMATCHED, F.lit(False))).select(
        REF, F.when(F.col("_st").isNull(), F.lit("transaction not found"))
        .otherwise(F.format_string("only MISMATCHED transactions can be retried (status %s)", F.col("_st")))
        .alias("reason"))
    b = queue.select(*[F.col(c).alias(f"b_{c}") if c != REF else F.col(c) for c in QUEUE_COLUMNS])
    j = b.join(ok.withColumn("_new", F.lit(True)), REF, "full_outer")
    hit = F.coalesce(F.col("_new"), F.lit(False))
    exists = F.col("b_status").isNotNull()
    exh = F.col("b_status") == EXHAUSTED
    q = j.select(
        REF,
        F.when(hit & exists & ~exh, F.col("b_attempt_count")).when(hit, F.lit(0))
        .otherwise(F.col("b_attempt_count")).cast("int").alias("attempt_count"),
        F.when(hit, F.lit(int(max_attempts))).otherwise(F.col("b_max_attempts")).cast("int").alias("max_attempts"),
        F.col("b_last_attempted_at").alias("last_attempted_at"),
        F.when(hit, now).otherwise(F.col("b_next_retry_at")).alias("next_retry_at"),
        F.when(hit & exists & ~exh, F.col("b_status")).when(hit, F.lit(PENDING))
        .otherwise(F.col("b_status")).alias("status"),
        F.when(hit, F.lit(requested_by)).otherwise(F.col("b_requested_by")).alias("requested_by"),
        F.coalesce(F.col("b_created_at"), now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("b_updated_at")).alias("updated_at"),
    )
    audit = A.events(ok, "RETRY_ENQUEUED", F.lit(MISMATCHED), F.lit(MISMATCHED),
                     F.to_json(F.struct(F.lit(int(max_attempts)).alias("max_attempts"),
                                        F.lit(requested_by).alias("requested_by"))), as_of, batch_id)
    return EnqueueOutcome(q, audit, rej)


def due_retries(queue: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    """LM-4: PENDING rows with next_retry_at <= as_of, oldest first."""
    due = queue.filter((F.col("status") == PENDING) & (F.col("next_retry_at") <= as_ts(as_of)))
    if limit is not None:
        return due.orderBy("next_retry_at", REF).limit(int(limit))
    return due


def queue_stats(queue: DataFrame) -> DataFrame:
    """AG-6: counts by status."""
    return queue.agg(F.count_if(F.col("status") == PENDING).alias("pending"),
                     F.count_if(F.col("status") == EXHAUSTED).alias("exhausted"),
                     F.count_if(F.col("status") == RESOLVED).alias("resolved"))


def queue_page(queue: DataFrame, page_size: int = 50, after: tuple | None = None,
               status: str | None = None) -> DataFrame:
    """LM-3: status filter, ordered by (next_retry_at, ref); keyset cursor
    ``after=(next_retry_at, ref)`` (D14); size 1..200 else 50."""
    size = page_size if 1 <= page_size <= 200 else 50
    q = queue if status is None else queue.filter(F.col("status") == status)
    if after is not None:
        t, ref = as_ts(after[0]), F.lit(after[1])
        q = q.filter((F.col("next_retry_at") > t) | ((F.col("next_retry_at") == t) & (F.col(REF) > ref)))
    return q.orderBy("next_retry_at", REF).limit(size)


def transition(due: DataFrame, outcome: DataFrame, as_of, policy: RetryPolicy | None = None) -> DataFrame:
    """RT-3 per due row, given the engine's ``status`` after the retrigger
    (ERROR = matcher error). Adds ``new_*`` queue columns and ``event``."""
    policy = policy or RetryPolicy()
    now = as_ts(as_of)
    j = due.join(outcome.select(REF, F.col("status").alias("engine_status")), REF, "left")
    attempt = F.col("attempt_count") + 1
    es = F.coalesce(F.col("engine_status"), F.lit(ERROR))
    done = es.isin(MATCHED, RESOLVED)
    exhaust = (es == MISMATCHED) & (attempt >= F.col("max_attempts"))
    bump = ~done & ~exhaust
    nxt = add_seconds(now, backoff_seconds(attempt, policy.base_backoff_secs, policy.max_backoff_secs))
    return j.select(
        "*", attempt.alias("attempt"), es.alias("engine_status_final"),
        F.when(done, F.lit(RESOLVED)).when(exhaust, F.lit(EXHAUSTED)).otherwise(F.col("status")).alias("new_status"),
        F.when(bump, attempt).otherwise(F.col("attempt_count")).cast("int").alias("new_attempt_count"),
        F.when(bump, now).otherwise(F.col("last_attempted_at")).alias("new_last_attempted_at"),
        F.when(bump, nxt).otherwise(F.col("next_retry_at")).alias("new_next_retry_at"),
        F.when(done, F.lit("RETRY_RESOLVED")).when(exhaust, F.lit("RETRY_EXHAUSTED"))
        .when(es == ERROR, F.lit("RETRY_ENGINE_ERROR")).when(es == MISMATCHED, F.lit("RETRY_ATTEMPT"))
        .alias("event"),
    )


def apply_transitions(queue: DataFrame, moved: DataFrame, as_of) -> DataFrame:
    """SNK-7: write the transitioned rows back into the queue."""
    now = as_ts(as_of)
    m = moved.select(REF, "new_status", "new_attempt_count", "new_last_attempted_at", "new_next_retry_at")
    j = queue.join(m, REF, "left")
    hit = F.col("new_status").isNotNull()
    out = []
    for c in QUEUE_COLUMNS:
        if c in ("status", "attempt_count", "last_attempted_at", "next_retry_at"):
            out.append(F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(hit, now).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


@dataclass
class RetryRunOutcome:
    queue: DataFrame
    transitions: DataFrame
    audit_delta: DataFrame
    tables: object            # plans.batch.ReconTables after the retrigger
    resolutions: DataFrame | None


def run_retries(tables, queue: DataFrame, rules: MatchRules, as_of, policy: RetryPolicy | None = None,
                auto: AutoResolveConfig | None = None, limit: int | None = None,
                batch_id: str = "retry") -> RetryRunOutcome:
    """RT-3/RT-4: one retry run over every due queue row. The retrigger's decisions
    and the transitions are written once (to the checkpoint folder): queue, audit,
    tables and resolutions all read them."""
    from ledgermesh.plans.batch import retrigger  # local import: plans depend on operators
    policy = policy or RetryPolicy()
    due = due_retries(queue, as_of, limit)
    rt = retrigger(tables, due.select(REF), rules, as_of, batch_id=batch_id, materialize=True)
    outcome = rt.decisions.select(REF, "status")
    moved = transition(due, outcome, as_of, policy).checkpoint()
    details = F.to_json(F.struct(F.col("attempt"), F.col("max_attempts"), F.col("engine_status_final")
                                 .alias("engine_status")))
    audit = A.events(moved.filter(F.col("event").isNotNull()), F.col("event"), F.lit(MISMATCHED),
                     F.when(F.col("event") == "RETRY_RESOLVED", F.col("engine_status_final"))
                     .otherwise(F.lit(MISMATCHED)), details, as_of, batch_id, seq=2)
    new_queue = apply_transitions(queue, moved, as_of)
    resolutions = None
    new_tables = rt.tables
    if auto is not None and auto.auto_apply_on_exhaustion:
        exhausted = moved.filter(F.col("new_status") == EXHAUSTED).select(REF)
        res = RS.auto_resolve(exhausted, new_tables.state, new_tables.records, new_tables.details, as_of,
                              strategy=auto.default_strategy, cfg=auto, resolver_id="system:retry_worker",
                              batch_id=batch_id, queue=new_queue)
        resolutions = res.resolutions
        new_tables.state = res.state
        new_queue = res.queue
        audit = audit.unionByName(res.audit_delta.withColumn("seq", F.lit(3)))
    new_tables.audit = A.append_audit(new_tables.audit, audit)
    return RetryRunOutcome(new_queue, moved, audit, new_tables, resolutions)
