"""MON-1, MON-2 and MON-5 as a stream, and STR-4 as a stream join.

``stream_rates`` counts submissions per window, source and status, with the payload
size buckets, in one watermarked aggregation in update mode: a late row corrects
its window until the watermark passes it. Each micro-batch replaces the windows
that changed in the days they belong to (``DayTable``); the three monitoring
views are sums over that table. Rows behind the watermark are not counted;
``behind_watermark`` counts them apart.

``late_records`` joins decisions with the records that land after them, within a
horizon, as an outer interval join of two streams with watermarks on both sides:
a decision that no record follows comes out with nulls once the horizon is over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgermesh.operators import monitoring as MON
from ledgermesh.operators.matching import REF
from ledgermesh.plans.store import BucketTable, EpochTable, buckets_of
from ledgermesh.streaming.jobs import trigger_options

_SIZES = [f"le_{b}" for b in MON.PAYLOAD_BUCKETS] + ["le_inf"]
RATE_SCHEMA = "window_start timestamp_ntz, source_system string, status string, records long, " + ", ".join(
    f"{c} long" for c in _SIZES)
KEYS = ["window_start", "source_system", "status"]


class DayTable(BucketTable):
    """Rows replaced by day: the bucket of a row is its day, counted from 1970."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        EpochTable.__init__(self, spark, path, schema, "bucket")
        self.key = key

    def bucket(self, key: str | None = None) -> Column:
        return F.floor(F.unix_seconds(F.col(key or self.key).cast("timestamp")) / 86400).cast("int")


def rate_table(spark: SparkSession, path: str) -> DayTable:
    return DayTable(spark, path, RATE_SCHEMA, "window_start")


def windowed_counts(labelled: DataFrame, width: str, watermark: str) -> DataFrame:
    """``labelled`` holds ``server_received_at``, ``source_system``, ``idem_label`` and
    ``payload_bytes``."""
    rows = labelled.withColumn("_at", F.col("server_received_at").cast("timestamp")).withWatermark("_at", watermark)
    sizes = [F.count_if(F.col("payload_bytes") <= b).alias(f"le_{b}") for b in MON.PAYLOAD_BUCKETS]
    counted = rows.groupBy(F.window("_at", width).alias("w"), "source_system", MON.ingest_status().alias("status")).agg(
        F.count(F.lit(1)).alias("records"), *sizes, F.count(F.lit(1)).alias("le_inf"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "source_system", "status",
                          "records", *_SIZES)


def stream_rates(labelled: DataFrame, path: str, checkpoint_location: str, width: str = "1 minute",
                 watermark: str = "1 hour", schedule: str = "available_now"):
    """Keep ``rate_table(path)`` up to date; returns the started query."""
    def batch(df: DataFrame, epoch_id: int):
        table = rate_table(df.sparkSession, path)
        if table.done(epoch_id):
            return
        changed = df.persist()  # the aggregation must run once a batch
        days = buckets_of(changed, table.bucket())
        new = changed.select(*[F.col(k).alias(f"_{k}") for k in KEYS])
        kept = table.read(days, epoch_id).join(new, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS], "left_anti")
        table.write(kept.unionByName(changed), epoch_id)
        table.tidy()
        changed.unpersist()

    return (windowed_counts(labelled, width, watermark).writeStream.outputMode("update").foreachBatch(batch)
            .option("checkpointLocation", checkpoint_location).trigger(**trigger_options(schedule)).start())


def ingestion_rate(rates: DataFrame, width_secs: int = 60) -> DataFrame:
    """MON-1 from the streamed windows."""
    return rates.select("window_start", "source_system", "status", "records",
                        (F.col("records") / F.lit(float(width_secs))).alias("per_second"))


def error_rate(rates: DataFrame) -> DataFrame:
    """MON-2 from the streamed windows."""
    failed = F.sum(F.when(F.col("status") == "failed", F.col("records")).otherwise(0)).alias("failed")
    return rates.groupBy("window_start").agg(F.sum("records").alias("total"), failed)


def payload_size_histogram(rates: DataFrame) -> DataFrame:
    """MON-5 from the streamed windows."""
    wide = rates.groupBy("source_system").agg(*[F.sum(c).alias(c) for c in _SIZES])
    pairs = ", ".join([f"'{b}', le_{b}" for b in MON.PAYLOAD_BUCKETS] + ["'+Inf', le_inf"])
    return wide.select("source_system", F.expr(f"stack({len(_SIZES)}, {pairs}) as (le, cumulative_count)"))


def behind_watermark(labelled: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows per source that came behind the watermark: landed less counted."""
    landed = labelled.groupBy(F.col("source_system").alias("s")).agg(F.count(F.lit(1)).alias("landed"))
    counted = rates.groupBy("source_system").agg(F.sum("records").alias("counted"))
    return landed.join(counted, F.col("s").eqNullSafe(F.col("source_system")), "left").select(
        F.col("s").alias("source_system"), (F.col("landed") - F.coalesce("counted", F.lit(0))).alias("late"))


def late_records(decisions: DataFrame, records: DataFrame, horizon: str = "30 days",
                 watermark: str = "1 hour") -> DataFrame:
    """STR-4 on streams. ``decisions``: ``transaction_ref, status, decided_at``;
    ``records``: ``transaction_ref, internal_id, landed_at``. One row per record that
    landed after a decision of its ref and within ``horizon`` of it, and one with
    null ``internal_id`` per decision without any; the refs of the former are
    stale."""
    d = decisions.select(REF, "status", F.col("decided_at").cast("timestamp").alias("decided_at")).withWatermark(
        "decided_at", watermark)
    r = records.select(F.col(REF).alias("_ref"), "internal_id", F.col("landed_at").cast("timestamp").alias("landed_at")) \
        .withWatermark("landed_at", watermark)
    after = F.expr(f"{REF} = _ref AND landed_at > decided_at AND landed_at <= decided_at + INTERVAL {horizon}")
    return d.join(r, after, "left_outer").select(REF, "status", "decided_at", "internal_id", "landed_at")
