"""Reconciliation state (T4), match details (T5), due work and status
propagation (STA-1/2, SNK-3/4, JN-1/4/5, LM-1, STR-4).

State tables are immutable snapshots: an update reads one and returns the next
as a DataFrame. ``plans.store`` keeps them in hash buckets of the ref, so an
update reads and rewrites only the buckets that its refs fall into. All joins
are equi-joins on ``transaction_ref``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermesh.functions.times import as_ts
from ledgermesh.operators.matching import MATCHED, MISMATCHED, PENDING, REF, RESOLVED

STATE_SCHEMA = (
    "transaction_ref string, status string, record_count bigint, matched_sources array<string>, "
    "mismatched_sources array<string>, retry_count int, max_retries int, last_processed_at timestamp_ntz, "
    "resolved_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
)
DETAILS_SCHEMA = (
    "transaction_ref string, system_name string, internal_id string, amount decimal(22,6), currency string, "
    "discrepancy_found boolean, discrepancy_details string, processed_at timestamp_ntz"
)
STATE_COLUMNS = [f.split()[0] for f in STATE_SCHEMA.split(", ")]
DETAILS_COLUMNS = [f.split()[0] for f in DETAILS_SCHEMA.split(", ")]


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def empty_details(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DETAILS_SCHEMA)


def upsert_state(base: DataFrame, delta: DataFrame, as_of, max_retries: int = 3,
                 stored_base: bool = False) -> DataFrame:
    """STA-1 / SNK-3: merge decisions into state.

    New ref: retry_count 1, max_retries from the rules. Existing ref: status,
    counts and source lists replaced, retry_count + 1, created_at and
    max_retries kept, resolved_at set only on MATCHED/RESOLVED else kept.

    Default plan: one full outer join (each input read once, so chained
    in-memory upserts stay linear). ``stored_base=True`` (the base is a written
    snapshot) plans ``base LEFT JOIN delta`` plus ``delta LEFT ANTI base refs``:
    with a small delta AQE broadcasts it and the base is read in place rather
    than shuffled; the base is read twice, which is cheap only from storage.
    """
    if stored_base:
        return _upsert_split(base, delta, as_of, max_retries)
    now = as_ts(as_of)
    b = base.select(*[F.col(c).alias(f"b_{c}") if c != REF else F.col(c) for c in STATE_COLUMNS])
    d = delta.select(REF, F.col("status").alias("d_status"), F.col("record_count").alias("d_record_count"),
                     F.col("matched_sources").alias("d_matched"), F.col("mismatched_sources").alias("d_mismatched"))
    j = b.join(d, REF, "full_outer")
    has_d = F.col("d_status").isNotNull()
    has_b = F.col("b_status").isNotNull()

    def pick(new, old):
        return F.when(has_d, new).otherwise(old)

    resolved_now = F.col("d_status").isin(MATCHED, RESOLVED)
    return j.select(
        REF,
        pick(F.col("d_status"), F.col("b_status")).alias("status"),
        pick(F.col("d_record_count").cast("bigint"), F.col("b_record_count")).alias("record_count"),
        pick(F.col("d_matched"), F.col("b_matched_sources")).alias("matched_sources"),
        pick(F.col("d_mismatched"), F.col("b_mismatched_sources")).alias("mismatched_sources"),
        pick(F.when(has_b, F.col("b_retry_count") + 1).otherwise(F.lit(1)), F.col("b_retry_count"))
        .cast("int").alias("retry_count"),
        F.coalesce(F.col("b_max_retries"), F.lit(int(max_retries))).cast("int").alias("max_retries"),
        pick(now, F.col("b_last_processed_at")).alias("last_processed_at"),
        pick(F.when(resolved_now, now).otherwise(F.col("b_resolved_at")), F.col("b_resolved_at"))
        .alias("resolved_at"),
        F.coalesce(F.col("b_created_at"), now).alias("created_at"),
        pick(now, F.col("b_updated_at")).alias("updated_at"),
    )


def _upsert_split(base: DataFrame, delta: DataFrame, as_of, max_retries: int) -> DataFrame:
    now = as_ts(as_of)
    b = base.select(*[F.col(c).alias(f"b_{c}") if c != REF else F.col(c) for c in STATE_COLUMNS])
    d = delta.select(REF, F.col("status").alias("d_status"), F.col("record_count").alias("d_record_count"),
                     F.col("matched_sources").alias("d_matched"), F.col("mismatched_sources").alias("d_mismatched"))
    has_d = F.col("d_status").isNotNull()

    def pick(new, old):
        return F.when(has_d, new).otherwise(old)

    upd = b.join(d, REF, "left").select(
        REF,
        pick(F.col("d_status"), F.col("b_status")).alias("status"),
        pick(F.col("d_record_count").cast("bigint"), F.col("b_record_count")).alias("record_count"),
        pick(F.col("d_matched"), F.col("b_matched_sources")).alias("matched_sources"),
        pick(F.col("d_mismatched"), F.col("b_mismatched_sources")).alias("mismatched_sources"),
        pick(F.col("b_retry_count") + 1, F.col("b_retry_count")).cast("int").alias("retry_count"),
        F.col("b_max_retries").cast("int").alias("max_retries"),
        pick(now, F.col("b_last_processed_at")).alias("last_processed_at"),
        pick(F.when(F.col("d_status").isin(MATCHED, RESOLVED), now).otherwise(F.col("b_resolved_at")),
             F.col("b_resolved_at")).alias("resolved_at"),
        F.col("b_created_at").alias("created_at"),
        pick(now, F.col("b_updated_at")).alias("updated_at"),
    )
    new = d.join(base.select(REF), REF, "left_anti").select(
        REF, F.col("d_status").alias("status"), F.col("d_record_count").cast("bigint").alias("record_count"),
        F.col("d_matched").alias("matched_sources"), F.col("d_mismatched").alias("mismatched_sources"),
        F.lit(1).cast("int").alias("retry_count"), F.lit(int(max_retries)).cast("int").alias("max_retries"),
        now.alias("last_processed_at"),
        F.when(F.col("d_status").isin(MATCHED, RESOLVED), now).alias("resolved_at"),
        now.alias("created_at"), now.alias("updated_at"))
    return upd.unionByName(new)


def reset_for_retrigger(state: DataFrame, refs: DataFrame, as_of) -> DataFrame:
    """MT-16 step 1: status PENDING, retry_count 0, last_processed_at NULL."""
    hit = refs.select(REF).distinct().withColumn("_hit", F.lit(True))
    j = state.join(hit, REF, "left")
    h = F.coalesce(F.col("_hit"), F.lit(False))
    cols = []
    for c in STATE_COLUMNS:
        if c == "status":
            cols.append(F.when(h, F.lit(PENDING)).otherwise(F.col(c)).alias(c))
        elif c == "retry_count":
            cols.append(F.when(h, F.lit(0)).otherwise(F.col(c)).cast("int").alias(c))
        elif c == "last_processed_at":
            cols.append(F.when(h, F.lit(None).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(h, as_ts(as_of)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def mark_resolved(state: DataFrame, refs: DataFrame, as_of, parity: bool = False) -> DataFrame:
    """STA-2: status RESOLVED for ``refs``; also stamps resolved_at unless
    ``parity`` (the reference leaves it unset, D16)."""
    hit = refs.select(REF).distinct().withColumn("_hit", F.lit(True))
    j = state.join(hit, REF, "left")
    h = F.coalesce(F.col("_hit"), F.lit(False))
    now = as_ts(as_of)
    cols = []
    for c in STATE_COLUMNS:
        if c == "status":
            cols.append(F.when(h, F.lit(RESOLVED)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(h, now).otherwise(F.col(c)).alias(c))
        elif c == "resolved_at" and not parity:
            cols.append(F.when(h, now).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def due_refs(records: DataFrame, state: DataFrame, as_of, backoff_secs: int = 30,
             limit: int | None = None, pending_timeout_secs: int | None = None,
             landed: DataFrame | None = None, waiting: DataFrame | None = None) -> DataFrame:
    """JN-1 / LM-1: refs needing a match run.

    Never processed, or PENDING with retries left whose last run is older than
    ``as_of - backoff``. With ``pending_timeout_secs`` also PENDING refs whose
    first record is older than the timeout (D8: escalation stays reachable).
    ``limit`` keeps the reference's polling batch (ordered by ref); the batch
    job itself takes every due ref at once.

    ``landed`` (the records that arrived in storage since the previous run,
    whatever their time stamps say) makes the run incremental: never-processed
    refs can only be among them, and all others come from the state, so a run
    does not aggregate the whole record history. ``waiting`` (refs whose timeout
    may have passed, from ``operators.due``) spares the scan of the record
    history for old PENDING refs. The result is the same.
    """
    cutoff = as_ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int(backoff_secs)))
    retry = ((F.col("status") == PENDING) & (F.col("retry_count") < F.col("max_retries"))
             & (F.col("last_processed_at").isNull() | (F.col("last_processed_at") < cutoff)))
    fresh = (records if landed is None else landed).select(REF).distinct().join(state.select(REF), REF, "left_anti")
    out = fresh.unionByName(state.filter(retry).select(REF))
    if pending_timeout_secs is not None:
        limit_ts = as_ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int(pending_timeout_secs)))
        if waiting is None:
            waiting = records.filter(F.col("server_received_at") <= limit_ts)
        old = (waiting.select(REF).distinct()
               .join(state.filter(F.col("status") == PENDING).select(REF), REF, "left_semi"))
        out = out.unionByName(old)
    out = out.distinct() if pending_timeout_secs is not None else out
    if limit is not None:
        out = out.orderBy(REF).limit(int(limit))
    return out


def upsert_details(base: DataFrame, delta: DataFrame) -> DataFrame:
    """SNK-4: replace rows on (transaction_ref, system_name); others kept."""
    keys = [REF, "system_name"]
    kept = base.join(delta.select(*keys), keys, "left_anti")
    return kept.select(*DETAILS_COLUMNS).unionByName(delta.select(*DETAILS_COLUMNS))


def propagate_status(records: DataFrame, state: DataFrame) -> DataFrame:
    """JN-4: copy a non-PENDING state status onto every record of the ref."""
    s = state.filter(F.col("status") != PENDING).select(REF, F.col("status").alias("_st"))
    j = records.join(s, REF, "left")
    base_status = F.col("status") if "status" in records.columns else F.lit(PENDING)
    return j.withColumn("status", F.coalesce(F.col("_st"), base_status)).drop("_st")


def stale_decisions(records: DataFrame, state: DataFrame) -> DataFrame:
    """STR-4: decided refs (MATCHED/MISMATCHED) with records the decision did
    not see: more records than counted, or a record newer than the run."""
    r = records.groupBy(REF).agg(F.count(F.lit(1)).alias("current_record_count"),
                                 F.max("server_received_at").alias("latest_record_at"))
    s = state.filter(F.col("status").isin(MATCHED, MISMATCHED)).select(
        REF, "status", F.col("record_count").alias("decided_record_count"), "last_processed_at")
    return (s.join(r, REF, "inner")
            .filter((F.col("current_record_count") > F.col("decided_record_count"))
                    | (F.col("latest_record_at") > F.col("last_processed_at"))))


def state_report(state: DataFrame, details: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """JN-5: state plus its details array per ref; times also as unix millis."""
    s = state if refs is None else state.join(refs.select(REF).distinct(), REF, "left_semi")
    d = details if refs is None else details.join(refs.select(REF).distinct(), REF, "left_semi")
    per_ref = d.groupBy(REF).agg(F.array_sort(F.collect_list(F.struct(
        "system_name", "internal_id", "amount", "currency", "discrepancy_found", "discrepancy_details"))).alias("details"))
    last = F.coalesce("last_processed_at", "updated_at")
    return (s.join(per_ref, REF, "left")
            .withColumn("last_updated_ms", F.unix_millis(last.cast("timestamp")))
            .withColumn("details", F.coalesce("details", F.array().cast(per_ref.schema["details"].dataType))))
