"""STR-2: per-ref stateful stream matching with a pending-timeout timer.

``transformWithState`` keyed by ``transaction_ref`` keeps, per ref, a map of the
latest record of each source (bounded by the number of source systems), the
first arrival, and whether the ref is closed. When a ref receives records, or
when its event-time timer (first arrival + pending timeout) fires, the
operator emits the ref's current per-source rows. The decision itself is not
made in Python: ``foreachBatch`` runs the same ``decide`` plan as the batch
engine over the emitted rows and updates the touched buckets of state and
details, the audit events and the errors. Unlike the polling engine, a ref is
re-decided on every arrival.

An open ref keeps its sources until it is decided by its timer, however late its
next record comes; the watermark moves timers only and drops no record. A closed
ref keeps one flag, so that later records are ignored (D9) and never start from
nothing. State lives in RocksDB on the executors, checkpointed to the shared
checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgermesh.config import MatchRules
from ledgermesh.functions.amounts import AMOUNT_SQL
from ledgermesh.operators import audit as A
from ledgermesh.operators.matching import REF, Reconciliation, canonical_records, decide
from ledgermesh.plans.batch import ReconTables, apply_decisions
from ledgermesh.plans.store import buckets_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SOURCE = "internal_id string, amount string, currency string, amount_text string, at long, first long, n long"
EMIT = f"transaction_ref string, source_system string, {SOURCE}, as_of long, timed_out boolean"
Emitted = Row(*[c.split()[0] for c in EMIT.split(", ")])


def start_stateful(writer):
    """Start a query with RocksDB state, leaving the session's setting as it was."""
    conf = writer._spark.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


class LatestBySource(StatefulProcessor):
    """Times are microseconds; ``timeout`` too, or None for no timer."""

    def __init__(self, timeout: int | None):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sources = handle.getMapState("sources", "source_system string", SOURCE)
        self.first = handle.getValueState("first", "first long")
        self.closed = handle.getValueState("closed", "closed boolean")

    def _emit(self, ref: str, as_of: int | None):
        rows = [(k[0], *v) for k, v in self.sources.iterator()]
        now = max(r[5] for r in rows) if as_of is None else as_of
        return [Emitted(ref, *r, now, as_of is not None) for r in rows]

    def _close(self, ref: str, first: int):
        out = self._emit(ref, first + self.timeout)
        self.sources.clear()
        self.first.clear()
        self.closed.update((True,))
        return out

    def handleInputRows(self, key, rows, timerValues):
        if self.closed.exists():
            return  # decided by the timer: later records are ignored (D9)
        rows = list(rows)  # a ref's records in one micro-batch, which the source's options bound
        before = self.first.get()[0] if self.first.exists() else None
        first = min([r.at for r in rows] + ([] if before is None else [before]))
        if self.timeout is not None:
            rows = [r for r in rows if r.at <= first + self.timeout]  # the ref is closed from then on
        new: dict[str, tuple] = {}
        for r in rows:
            old = new.get(r.source_system)
            if old is None and self.sources.containsKey((r.source_system,)):
                old = tuple(self.sources.getValue((r.source_system,)))
            own = (r.internal_id, r.amount, r.currency, r.amount_text, r.at, r.at, 1)
            if old is not None:  # a source's latest record; times and ids order them
                last = own if (r.at, r.internal_id) > (old[4], old[0]) else old
                own = (*last[:5], min(r.at, old[5]), old[6] + 1)
            new[r.source_system] = own
        for source, value in new.items():
            self.sources.updateValue((source,), value)
        if first != before:
            self.first.update((first,))
        if self.timeout is not None:
            due = -(-(first + self.timeout) // 1000)  # timers are in milliseconds
            if due <= timerValues.getCurrentWatermarkInMs():
                yield from self._close(key[0], first)  # late records of a ref already past its timeout
                return
            if first != before:
                if before is not None:
                    self.handle.deleteTimer(-(-(before + self.timeout) // 1000))
                self.handle.registerTimer(due)
        if rows:
            yield from self._emit(key[0], None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.closed.exists() and self.first.exists():
            yield from self._close(key[0], self.first.get()[0])

    def close(self) -> None:
        pass


def latest_by_source_state(records: DataFrame, pending_timeout_secs: int | None,
                           watermark_delay: str = "10 minutes") -> DataFrame:
    """The stateful step: the per-source rows of each ref that received records
    or timed out."""
    rec = canonical_records(records).withColumn("_event", F.col("server_received_at").cast("timestamp"))
    rec = rec.withWatermark("_event", watermark_delay).select(
        # without the event-time column: Spark must not drop late records here
        REF, "source_system", "internal_id", F.col("amount").cast("string").alias("amount"), "currency", "amount_text",
        F.unix_micros("_event").alias("at"))
    timeout = None if pending_timeout_secs is None else int(pending_timeout_secs) * 1_000_000
    return rec.groupBy(REF).transformWithState(LatestBySource(timeout), EMIT, "Append", "EventTime")


def decide_emitted(rows: DataFrame, rules: MatchRules, run_time) -> Reconciliation:
    """Decide each emitted ref once, by its last emission of the batch (its
    timer's, if that fired), as of that emission."""
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    last = rows.groupBy(REF).agg(F.max(F.struct("timed_out", "as_of")).alias("last"))
    rows = rows.join(last, REF).filter((F.col("timed_out") == F.col("last.timed_out")) & (F.col("as_of") == F.col("last.as_of")))
    elem = F.struct(at("at").alias("ts"), F.col("source_system").alias("source_system"), "internal_id",
                    F.col("amount").cast(AMOUNT_SQL).alias("amount"), "currency", "amount_text")
    grouped = rows.groupBy(REF).agg(F.array_sort(F.collect_list(elem)).alias("recs"),  # one per source
                                    F.sum("n").alias("record_count"), at(F.min("first")).alias("first_seen_at"),
                                    at(F.max("as_of")).alias("as_of"))
    return Reconciliation(decide(grouped, rules, F.col("as_of")), rules, run_time)


def stream_match(records_stream: DataFrame, store_dir: str, checkpoint_location: str, rules: MatchRules,
                 schedule: str = "available_now", watermark_delay: str = "10 minutes", buckets: int = 64):
    """STR-2 end to end: stateful emission, a set-based decision per micro-batch,
    and the touched buckets of state and details, audit events and errors under
    ``store_dir`` (``jobs.EngineTables``). A batch's run time is the latest time
    of its emissions."""
    from ledgermesh.streaming.jobs import EngineTables, trigger_options
    emitted = latest_by_source_state(records_stream, rules.pending_timeout_secs, watermark_delay)

    def batch(df: DataFrame, epoch_id: int):
        t = EngineTables(df.sparkSession, store_dir, buckets)
        if t.state.done(epoch_id):
            return  # replayed micro-batch: it had come to its end
        df = df.persist()  # the stateful operator must run once a batch
        run_time = df.agg(F.timestamp_micros(F.max("as_of")).cast("timestamp_ntz")).first()[0]
        if run_time is not None:
            rec = decide_emitted(df, rules, run_time)
            rec = Reconciliation(rec.refs.checkpoint(), rules, run_time)
            bucket = t.state.bucket()
            changed = buckets_of(rec.decisions(), bucket)
            state, details = t.state.read(changed, epoch_id), t.details.read(changed, epoch_id)
            out = apply_decisions(ReconTables(df, state, details, A.empty_audit(df.sparkSession)), state, rec,
                                  f"epoch-{epoch_id}", stored_base=True)
            t.details.write(out.tables.details, epoch_id)
            out.audit_delta.write.mode("overwrite").parquet(f"{t.audit_dir}/epoch={epoch_id}")
            out.errors.write.mode("overwrite").parquet(f"{t.errors_dir}/epoch={epoch_id}")
            t.state.write(out.tables.state, epoch_id)  # written last: it marks the batch done
            t.state.tidy()
            t.details.tidy()
        df.unpersist()

    return start_stateful(emitted.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_location)
                          .trigger(**trigger_options(schedule)))
