"""Streaming jobs built from the batch operators with ``foreachBatch``.

* STR-1 ``streaming.ingest.stream_ingest``: envelopes stream -> pipeline ->
  idempotency by keyed state -> submissions per label.
* STR-3 ``incremental_match``: records stream -> refs touched by the
  micro-batch plus due refs of the due calendar -> one set-based reconcile ->
  the touched hash buckets of state and details (``plans.store``), audit events,
  errors, decided refs; a replayed batch that had come to its end is skipped.
* STR-5: ``trigger_options`` maps polling schedules to triggers
  (``availableNow`` for catch-up runs, ``processingTime`` for the reference's
  5 s / 30 s ticks).

The checkpoint location must be on the shared file system.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermesh.config import MatchRules
from ledgermesh.functions.times import as_ts
from ledgermesh.operators import audit as A
from ledgermesh.operators import due as DUE
from ledgermesh.operators import state as S
from ledgermesh.operators.matching import PENDING, REF
from ledgermesh.plans.batch import ReconTables, _run
from ledgermesh.plans.store import BucketTable, EpochTable, buckets_of


def trigger_options(schedule: str) -> dict:
    """'available_now' or an interval such as '5 seconds'."""
    if schedule == "available_now":
        return {"availableNow": True}
    return {"processingTime": schedule}


@dataclass
class EngineTables:
    """Everything the streaming engine stores under one folder, for its own
    batches and for readers (``state.read()`` and so on)."""
    spark: SparkSession
    path: str
    buckets: int = 64

    def __post_init__(self):
        at = lambda name: f"{self.path.rstrip('/')}/{name}"
        self.state = BucketTable(self.spark, at("state"), S.STATE_SCHEMA, REF, self.buckets)
        self.details = BucketTable(self.spark, at("details"), S.DETAILS_SCHEMA, REF, self.buckets)
        self.decided = EpochTable(self.spark, at("decided"), f"{REF} string, status string", "bucket")
        self.due = EpochTable(self.spark, at("due"), DUE.DUE_SCHEMA, "slot")
        self.audit_dir, self.errors_dir = at("audit"), at("errors")

    def records(self, path: str, schema: str) -> EpochTable:
        """The record history, dealt by the buckets of the state."""
        return EpochTable(self.spark, path, schema, "bucket")

    def audit(self) -> DataFrame:
        return self.spark.read.schema(f"{A.AUDIT_SCHEMA}, epoch int").parquet(self.audit_dir).drop("epoch")


def records_with_status(tables: EngineTables, records: EpochTable, parts: list[tuple[int, int]] | None = None) -> DataFrame:
    """JN-4: the stored records, each with the status that the last decision of its
    ref gave it. A decision covers the records that were there when it ran;
    later ones are PENDING, as in the batch engine."""
    rows = records.folders(records.parts() if parts is None else parts)
    of = {p for _, p in records.parts()} if parts is None else {p for _, p in parts}
    last = tables.decided.folders([x for x in tables.decided.parts() if x[1] in of]).groupBy(REF).agg(
        F.max(F.struct("epoch", "status")).alias("d"))
    covered = F.col("d.epoch") >= F.col("epoch")
    base = F.col("status") if "status" in rows.columns else F.lit(PENDING)
    return (rows.join(last, REF, "left").withColumn("status", F.when(covered, F.col("d.status")).otherwise(base))
            .drop("d", "epoch", "bucket"))


def incremental_match(records_stream: DataFrame, records_table: str, store_dir: str, checkpoint_location: str,
                      rules: MatchRules, schedule: str = "available_now", as_of_fn=None,
                      backoff_secs: int = 30, reopen: bool = False, escalate_timed_out: bool = True,
                      buckets: int = 64, on_batch=None):
    """STR-3. Each micro-batch appends its records to ``records_table``, runs the
    due refs and writes state, details, audit events, errors, decided refs and
    due entries under ``store_dir`` (``EngineTables``).

    State, details and records are dealt into hash buckets of the ref. A batch
    reads only the buckets of the refs that it received or that the due calendar
    names, and rewrites only the buckets of refs that it ran; its cost follows
    the batch, not the history. Every write replaces what a failed attempt of the
    same batch left, the state comes last and marks the batch done, so a replay
    leaves what one run would have left.

    Due are refs first seen in this batch and PENDING refs whose back-off elapsed;
    PENDING refs past the rules' pending timeout run whatever their retry count
    (D8) unless ``escalate_timed_out=False``. Refs whose amounts did not parse
    run again with every batch. Decided refs ignore later records (D9) unless
    ``reopen=True``, which also re-decides every ref the batch touched.

    ``on_batch(epoch, read, written)`` is told the buckets of every batch.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records_stream.schema)
    timeout = rules.pending_timeout_secs if escalate_timed_out else None

    def batch(df: DataFrame, epoch_id: int):
        spark = df.sparkSession
        t = EngineTables(spark, store_dir, buckets)
        history = t.records(records_table, schema)
        if t.state.done(epoch_id):
            return  # replayed micro-batch: it had come to its end
        as_of = as_of_fn(epoch_id) if as_of_fn else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        now = DUE.slot_at(as_of)
        bucket = t.state.bucket()
        history.write(df.withColumn("bucket", bucket), epoch_id)
        own = [x for x in history.parts() if x[0] == epoch_id]
        landed = history.folders(own)

        slots = [x for x in t.due.parts(before=epoch_id) if x[1] <= now]
        called = DUE.due_now(t.due.folders(slots), as_of)
        touched = sorted({b for _, b in own} | set(buckets_of(called, bucket)))
        state, details = t.state.read(touched, epoch_id), t.details.read(touched, epoch_id)
        records = history.folders([x for x in history.parts() if x[1] in touched and x[0] <= epoch_id]).drop("epoch", "bucket")

        waiting = None
        if timeout is not None:
            limit = as_ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int(timeout)))
            waiting = called.filter(F.col("kind") == DUE.TIMEOUT).select(REF).unionByName(
                landed.filter(F.col("server_received_at") <= limit).select(REF))
        fresh = landed.select(REF).unionByName(called.select(REF))  # called refs without a state failed before
        due = S.due_refs(records, state, as_of, backoff_secs, landed=fresh, waiting=waiting, pending_timeout_secs=timeout)
        refs = landed.select(REF).unionByName(due).distinct() if reopen else due
        out = _run(ReconTables(records, state, details, A.empty_audit(spark)), state, refs, rules, as_of,
                   f"epoch-{epoch_id}", seq=0, materialize=True, stored_base=True)

        ran = out.decisions.filter(F.col("gate") != "error")
        changed = buckets_of(ran, bucket)
        delta = out.tables.state.filter(bucket.isin(changed)).checkpoint()
        t.details.write(out.tables.details.filter(bucket.isin(changed)), epoch_id)
        out.audit_delta.write.mode("overwrite").parquet(f"{t.audit_dir}/epoch={epoch_id}")
        out.errors.write.mode("overwrite").parquet(f"{t.errors_dir}/epoch={epoch_id}")
        mine = delta.join(ran.select(REF), REF, "left_semi")
        t.decided.write(mine.filter(F.col("status") != PENDING).select(REF, "status", bucket.alias("bucket")), epoch_id)
        entries = DUE.retry_entries(mine, backoff_secs).unionByName(DUE.again_entries(out.errors, as_of))
        if timeout is not None:  # a ref that ran is decided or has its entry; other late records may bring one forward
            entries = entries.unionByName(DUE.timeout_entries(landed, timeout))
        t.due.write(entries, epoch_id)
        t.state.write(delta, epoch_id)  # written last: it marks the batch done
        if on_batch:
            on_batch(epoch_id, touched, changed)
        t.state.tidy()
        t.details.tidy()
        t.due.drop([x for x in slots if x[1] < now])

    return (records_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_location)
            .trigger(**trigger_options(schedule)).start())
