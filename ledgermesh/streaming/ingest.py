"""STR-1: streaming ingest with idempotency in Spark's state store.

The pipeline runs as narrow projections on the stream; then ``transformWithState``
keyed by ``idempotency_key`` remembers, per key, the id and time of the stored
submission, and labels each submission as the batch operator does (IDM-1, IDM-2).
A batch looks up the keys that it holds; stored records are never read again, so
the cost of a batch follows the batch. A key is kept for good, as the record
table has one row per key for good (a re-send after the TTL must be
``ignored_after_ttl``, not stored anew).

Each micro-batch is written once, in one pass over it, under
``<out>/submissions/epoch=<E>/idem_label=<label>`` in overwrite mode: records
(``stored``) and DLQ rows (``failed``) are partition-pruned reads of that table, and
counters taken on the way by ``DataFrame.observe`` go to ``<out>/counters/epoch=<E>``.

Submissions of one key that arrive in the same micro-batch are ordered in memory by
arrival time (ties: ``row_id``, else content), so a micro-batch, bounded by the
source's options, is what one key can take at most. Rows without a key fail
validation; they are spread and touch no state.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgermesh.config import IngestConfig
from ledgermesh.operators import pipeline as P
from ledgermesh.operators.idempotency import KEY
from ledgermesh.streaming.jobs import trigger_options
from ledgermesh.streaming.stateful import start_stateful

ERROR_COLUMNS = ("error_stage", "error_reason", "error_message")
LABELS = ("stored", "duplicate", "ignored_after_ttl", "failed")


class KeyedLabels(StatefulProcessor):
    """Labels one key's submissions. Rows end with ``_at`` (microseconds) and ``_tie``."""

    def __init__(self, ttl_secs: int, columns: list[str]):
        self.ttl, self.columns = ttl_secs * 1_000_000, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "internal_id string, at long")

    def _label(self, row, stored) -> str:
        if stored is None:
            return "failed"
        if row["_at"] < stored[1] + self.ttl:
            return "duplicate"
        return "ignored_after_ttl" if row["ok"] else "failed"

    def _out(self, row, label: str, stored):
        return Row(*self.columns, "idem_label", "stored_internal_id")(
            *[row[c] for c in self.columns], label, stored[0] if stored else None)

    def handleInputRows(self, key, rows, timerValues):
        if not rows_have_key(key[0]):
            for r in rows:
                yield self._out(r, "failed", None)
            return
        stored = tuple(self.stored.get()) if self.stored.exists() else None
        if stored is not None:
            for r in rows:
                yield self._out(r, self._label(r, stored), stored)
            return
        held = sorted(rows, key=lambda r: (r["_at"], r["_tie"]))
        first = next((k for k, r in enumerate(held) if r["ok"]), len(held))
        if first < len(held):
            stored = (held[first]["internal_id"], held[first]["_at"])
            self.stored.update(stored)
        for k, r in enumerate(held):
            yield self._out(r, "failed" if k < first else "stored" if k == first else self._label(r, stored), stored)

    def close(self) -> None:
        pass


_NO_KEY = "\u0000"


def rows_have_key(group: str) -> bool:
    return not group.startswith(_NO_KEY)


def labelled_stream(envelopes: DataFrame, as_of=None, cfg: IngestConfig | None = None) -> DataFrame:
    """The pipeline's columns of every submission with ``idem_label`` and
    ``stored_internal_id``. ``as_of`` (a time or a column) defaults to the time of
    each micro-batch, which Spark keeps for a replay."""
    cfg = cfg or IngestConfig()
    now = F.current_timestamp() if as_of is None else as_of
    done = P.run_pipeline(envelopes, now, cfg)
    tie = F.col("row_id") if "row_id" in done.columns else F.xxhash64("source_system", "payload_text")
    group = F.when(F.col(KEY) != "", F.col(KEY)).otherwise(
        F.concat(F.lit(_NO_KEY), F.xxhash64("server_received_at", "payload_text", "transaction_ref").cast("string")))
    slim = done.select(group.alias("_group"), *done.columns, F.unix_micros(F.col("server_received_at").cast("timestamp"))
                       .alias("_at"), tie.cast("long").alias("_tie"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema)
    return slim.groupBy("_group").transformWithState(
        KeyedLabels(cfg.idempotency_ttl_secs, done.columns),
        f"{fields}, idem_label string, stored_internal_id string", "Append", "None")


def _count(label: str) -> Column:
    return F.count_if(F.col("idem_label") == label)


def counters() -> list[Column]:
    """SRC-9, MON-3 and MON-4 totals, for ``DataFrame.observe``."""
    return [F.count_if(F.col("idem_label") != "failed").alias("total_processed"), _count("failed").alias("total_failed"),
            _count("stored").alias("total_stored"), _count("duplicate").alias("duplicate_hits"),
            _count("ignored_after_ttl").alias("ignored_after_ttl")]


def write_submissions(labelled: DataFrame, out_dir: str, epoch: int) -> dict:
    """Write a labelled batch in one pass, split by label, and return its counters."""
    seen = Observation()
    columns = [*P.RECORD_COLUMNS, "raw_payload", *ERROR_COLUMNS, "idem_label", "stored_internal_id"]
    columns += [c for c in ("row_id",) if c in labelled.columns]
    (labelled.observe(seen, *counters())
     .withColumn("raw_payload", F.coalesce("raw_payload", F.col("payload_text").cast("binary"))).select(*columns)
     .write.mode("overwrite").partitionBy("idem_label").parquet(f"{out_dir}/submissions/epoch={epoch}"))
    totals = {k: int(v) for k, v in seen.get.items()} or dict.fromkeys(
        ("total_processed", "total_failed", "total_stored", "duplicate_hits", "ignored_after_ttl"), 0)
    labelled.sparkSession.createDataFrame([Row(**totals)]).coalesce(1).write.mode("overwrite").parquet(
        f"{out_dir}/counters/epoch={epoch}")
    return totals


class IngestTables:
    """What ``stream_ingest`` wrote under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def submissions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/submissions")

    def records(self) -> DataFrame:
        """T1 rows."""
        return P.to_records(self.submissions().filter(F.col("idem_label") == "stored").withColumn(
            "payload_text", F.lit(None).cast("string")), only_ok=False)

    def dlq(self) -> DataFrame:
        """T3 rows."""
        return P.route_dlq(self.submissions().filter(F.col("idem_label") == "failed").withColumn(
            "payload_text", F.lit(None).cast("string")), only_failed=False)

    def counters(self) -> DataFrame:
        """One row per micro-batch."""
        return self.spark.read.parquet(f"{self.path}/counters")


def stream_ingest(envelopes: DataFrame, out_dir: str, checkpoint_location: str, cfg: IngestConfig | None = None,
                  schedule: str = "available_now", as_of: dt.datetime | Column | None = None):
    """STR-1. Returns the started ``StreamingQuery``; read ``IngestTables``."""
    def batch(df: DataFrame, epoch_id: int):
        write_submissions(df, out_dir, epoch_id)

    return start_stateful(labelled_stream(envelopes, as_of, cfg).writeStream.foreachBatch(batch)
                          .option("checkpointLocation", checkpoint_location).trigger(**trigger_options(schedule)))
