"""Monitoring aggregates (MON-1..11), as batch queries over the tables.

All are grouped aggregates with partial (map-side) aggregation, so a hot
source or status costs one partial row per task, not a hot partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgermesh.functions.times import as_ts
from ledgermesh.operators.matching import MISMATCHED, REF

# Payload size buckets 64 * 4^i (i = 0..9) and batch size buckets.
PAYLOAD_BUCKETS = tuple(64 * 4 ** i for i in range(10))
BATCH_BUCKETS = (0, 1, 5, 10, 25, 50, 100, 250, 500)

INGEST_STATUS = {"stored": "success", "duplicate": "duplicate", "ignored_after_ttl": "duplicate",
                 "failed": "failed"}


def ingest_status(label_col: str = "idem_label"):
    expr = F.lit(None).cast("string")
    for k, v in reversed(list(INGEST_STATUS.items())):
        expr = F.when(F.col(label_col) == k, F.lit(v)).otherwise(expr)
    return expr


def ingestion_rate(labelled: DataFrame, by: tuple[str, ...] = ("source_system",), width: str = "1 minute") -> DataFrame:
    """MON-1: records per tumbling window by (source, status); rate per second."""
    secs = (F.unix_seconds("w.end") - F.unix_seconds("w.start")).cast("double")
    return (labelled.groupBy(F.window(F.col("server_received_at").cast("timestamp"), width).alias("w"), *by,
                             ingest_status().alias("status"))
            .agg(F.count(F.lit(1)).alias("records"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "status", "records",
                    (F.col("records") / secs).alias("per_second")))


def error_rate(labelled: DataFrame, width: str = "1 minute") -> DataFrame:
    """MON-2: failed share per window."""
    return (labelled.groupBy(F.window(F.col("server_received_at").cast("timestamp"), width).alias("w"))
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("idem_label") == "failed").alias("failed"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "total", "failed"))


def payload_size_histogram(df: DataFrame, size_col: str = "payload_bytes", by: str = "source_system") -> DataFrame:
    """MON-5: cumulative counts ``size <= bound`` per source (one wide partial
    aggregate, then unpivot — no explode of rows x buckets)."""
    aggs = [F.count_if(F.col(size_col) <= b).alias(f"le_{b}") for b in PAYLOAD_BUCKETS]
    aggs.append(F.count(F.lit(1)).alias("le_inf"))
    wide = df.groupBy(by).agg(*aggs)
    pairs = ", ".join([f"'{b}', le_{b}" for b in PAYLOAD_BUCKETS] + ["'+Inf', le_inf"])
    return wide.select(by, F.expr(f"stack({len(PAYLOAD_BUCKETS) + 1}, {pairs}) as (le, cumulative_count)"))


def outcomes_by_status(state: DataFrame) -> DataFrame:
    """MON-6: refs per status; ``open_mismatches`` is the MISMATCHED count (D13)."""
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("refs"))


def open_mismatches(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if(F.col("status") == MISMATCHED).alias("open_mismatches"))


def decision_latency(state: DataFrame, records: DataFrame, width: int = 3600) -> DataFrame:
    """MON-7: exact discrete p50/p95 of (last_processed_at - first record) in
    seconds, per status. Latencies are counted per second, summed into coarse
    buckets of ``width`` seconds to find the bucket of each rank, and ranked
    exactly inside that bucket alone (``width`` rows at most)."""
    first = records.groupBy(REF).agg(F.min("server_received_at").alias("first_seen"))
    counts = (state.join(first, REF)
              .select("status", (F.unix_seconds(F.col("last_processed_at").cast("timestamp"))
                                 - F.unix_seconds(F.col("first_seen").cast("timestamp"))).alias("latency_s"))
              .groupBy("status", "latency_s").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("bucket", F.floor(F.col("latency_s") / width)))
    by_bucket = Window.partitionBy("status").orderBy("bucket")
    coarse = (counts.groupBy("status", "bucket").agg(F.sum("n").alias("n"))
              .withColumn("upto", F.sum("n").over(by_bucket))
              .withColumn("refs", F.sum("n").over(Window.partitionBy("status"))))
    wanted = (coarse.select("status", "bucket", "refs", (F.col("upto") - F.col("n")).alias("before"), "upto",
                            F.explode(F.array(*[F.struct(F.lit(name).alias("name"),
                                                         F.expr(f"cast(ceil(refs * {q}BD) as bigint)").alias("rank"))
                                                for name, q in (("p50_s", "0.5"), ("p95_s", "0.95"))])).alias("q"))
              .filter((F.col("q.rank") > F.col("before")) & (F.col("q.rank") <= F.col("upto")))
              .select("status", "bucket", "refs", "q.name", (F.col("q.rank") - F.col("before")).alias("rank")))
    inside = Window.partitionBy("status", "name").orderBy("latency_s")
    found = (wanted.join(counts, ["status", "bucket"]).withColumn("seen", F.sum("n").over(inside))
             .filter(F.col("seen") >= F.col("rank")))
    return found.groupBy("status").agg(F.min(F.when(F.col("name") == "p50_s", F.col("latency_s"))).alias("p50_s"),
                                       F.min(F.when(F.col("name") == "p95_s", F.col("latency_s"))).alias("p95_s"),
                                       F.max("refs").alias("refs"))


def latency_sketches(state: DataFrame, records: DataFrame, width: str = "1 minute", k: int = 400) -> DataFrame:
    """MON-7 per window: a KLL sketch of the decision latencies (seconds) of each
    window of ``last_processed_at`` and status, to keep in place of the rows."""
    first = records.groupBy(REF).agg(F.min("server_received_at").alias("first_seen"))
    rows = state.join(first, REF).select(
        "status", F.window(F.col("last_processed_at").cast("timestamp"), width).alias("w"),
        (F.unix_seconds(F.col("last_processed_at").cast("timestamp"))
         - F.unix_seconds(F.col("first_seen").cast("timestamp"))).alias("latency_s"))
    return rows.groupBy(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "status").agg(
        F.kll_sketch_agg_bigint("latency_s", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("refs"))


def latency_quantiles(sketches: DataFrame, since=None, until=None) -> DataFrame:
    """p50 and p95 per status over any range of windows, by merging their sketches
    (a sketch of ``k`` 400 is within about 0.7 % of the rank)."""
    rows = sketches
    if since is not None:
        rows = rows.filter(F.col("window_start") >= as_ts(since))
    if until is not None:
        rows = rows.filter(F.col("window_start") < as_ts(until))
    merged = rows.groupBy("status").agg(F.kll_merge_agg_bigint("sketch").alias("s"), F.sum("refs").alias("refs"))
    return merged.select("status", F.kll_sketch_get_quantile_bigint("s", F.lit(0.5)).alias("p50_s"),
                         F.kll_sketch_get_quantile_bigint("s", F.lit(0.95)).alias("p95_s"), "refs")


def batch_size_histogram(audit: DataFrame) -> DataFrame:
    """MON-8: MATCH_ATTEMPT rows per batch, bucketed (cumulative)."""
    sizes = audit.filter(F.col("event_type") == "MATCH_ATTEMPT").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("batch_size"))
    return payload_size_histogram_generic(sizes, "batch_size", BATCH_BUCKETS)


def payload_size_histogram_generic(df: DataFrame, col: str, bounds) -> DataFrame:
    aggs = [F.count_if(F.col(col) <= b).alias(f"le_{b}") for b in bounds] + [F.count(F.lit(1)).alias("le_inf")]
    wide = df.agg(*aggs)
    pairs = ", ".join([f"'{b}', le_{b}" for b in bounds] + ["'+Inf', le_inf"])
    return wide.select(F.expr(f"stack({len(bounds) + 1}, {pairs}) as (le, cumulative_count)"))


def resolutions_by_resolver(resolutions: DataFrame) -> DataFrame:
    """MON-9: resolutions by (type, resolver)."""
    return resolutions.groupBy("resolution_type", "resolver_id").agg(F.count(F.lit(1)).alias("resolutions"))


def auto_resolutions_per_minute(resolutions: DataFrame, rejections: DataFrame | None = None,
                                strategy: str | None = None, as_of=None) -> DataFrame:
    """MON-9: auto resolutions per minute by (strategy, outcome). ``rejections`` of
    the run with its ``strategy`` and time count as ``failed``."""
    rows = resolutions.filter(F.col("resolution_type") == "AUTO").select(
        "strategy", F.lit("success").alias("outcome"), F.col("resolved_at").alias("at"))
    if rejections is not None:
        rows = rows.unionByName(rejections.select(F.lit(strategy).alias("strategy"), F.lit("failed").alias("outcome"),
                                                  as_ts(as_of).alias("at")))
    return (rows.groupBy(F.window(F.col("at").cast("timestamp"), "1 minute").alias("w"), "strategy", "outcome")
            .agg(F.count(F.lit(1)).alias("resolutions"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "strategy", "outcome",
                    "resolutions"))


def retry_attempts_by_outcome(transitions: DataFrame) -> DataFrame:
    """MON-10: retry attempts by outcome label."""
    outcome = (F.when(F.col("new_status") == "RESOLVED", F.lit("matched"))
               .when(F.col("new_status") == "EXHAUSTED", F.lit("exhausted"))
               .when(F.col("engine_status_final") == "ERROR", F.lit("error"))
               .otherwise(F.lit("still_mismatched")))
    return transitions.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("attempts"))


def errors_by_ref(errors: DataFrame) -> DataFrame:
    """MON-11: reconciliation errors per ref."""
    return errors.groupBy(REF).agg(F.count(F.lit(1)).alias("errors"))


def retrigger_count(audit: DataFrame) -> DataFrame:
    """MON-11: RETRIGGER events."""
    return audit.agg(F.count_if(F.col("event_type") == "RETRIGGER").alias("retriggers"))


def rate_limited_by_source(labels: DataFrame) -> DataFrame:
    """MON-4: requests denied by the rate limiter, per source."""
    return labels.groupBy("source_system").agg(F.count_if(~F.col("allowed")).alias("rate_limited"),
                                               F.count(F.lit(1)).alias("requests"))
