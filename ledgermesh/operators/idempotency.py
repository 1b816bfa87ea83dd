"""Idempotent ingest (IDM-1..4) and the batch ingest entry point (SRC-9).

One stored record per ``idempotency_key`` globally; the first *successful*
submission wins (failures are not remembered). A later submission within the
TTL of the stored one is a ``duplicate`` and is not processed; after the TTL
it is processed again, and if it succeeds its insert is ignored
(``ignored_after_ttl``), so the key still has one row.

The per-key winner is a partial aggregate (``min`` of an order struct), joined
back on the key: a hot key is pre-aggregated map-side and its join partition
can be split by AQE; nothing collects a key's rows into one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgermesh.config import IngestConfig
from ledgermesh.operators import pipeline as P

KEY = "idempotency_key"


def _order(df: DataFrame) -> Column:
    """Arrival order of the submissions of a key. Without ``row_id`` equal
    arrival times fall back to the content, then to ``_arrival`` (see
    ``ingest_batch``), so exactly one of several identical rows comes first."""
    ties = ([F.col("row_id")] if "row_id" in df.columns else
            [F.xxhash64("source_system", "payload_text")] + [F.col(c) for c in ("_arrival",) if c in df.columns])
    return F.struct(F.col("server_received_at").alias("ts"), *[c.alias(f"tie{k}") for k, c in enumerate(ties)])


def _plus(ts: Column, secs: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(secs))


def stored_keys(existing: DataFrame) -> DataFrame:
    """``(key, id, time)`` of what earlier batches stored, from the records (T1)
    or the idempotency table (T2); one row per key."""
    if "response" in existing.columns:
        rows = existing.select(KEY, F.col("response.internal_id").alias("_old_id"), F.col("created_at").alias("_old_ts"))
    else:
        rows = existing.select(KEY, F.col("internal_id").alias("_old_id"), F.col("server_received_at").alias("_old_ts"))
    return (rows.groupBy(KEY).agg(F.min_by("_old_id", F.struct("_old_ts", "_old_id")).alias("_old_id"),
                                  F.min("_old_ts").alias("_old_ts")))


def label_idempotent(processed: DataFrame, ttl_secs: int = 24 * 3600, existing: DataFrame | None = None) -> DataFrame:
    """IDM-1/IDM-2: add ``idem_label`` in {stored, duplicate, ignored_after_ttl, failed}
    and ``stored_internal_id`` (the id a duplicate is answered with).

    ``existing`` (records or T2 rows of earlier batches) came before this
    batch: of a key stored there nothing is stored again, re-sends within the
    TTL of that store are duplicates whether they would pass or not, later ones
    are ``ignored_after_ttl`` or ``failed``. Rows without a key are ``failed``
    (VAL-1); they join nothing and are spread over all partitions.
    """
    df = processed.withColumn("_ord", _order(processed))
    has_key = F.col(KEY) != ""
    # conditional aggregation, not a filter: a filter on ``ok`` would be pushed
    # below the pipeline projections and re-evaluate them inside the predicate
    ok_ord = F.when(F.col("ok"), F.col("_ord"))
    first = (df.filter(has_key).groupBy(KEY)
             .agg(F.min(ok_ord).alias("_first"), F.min_by("internal_id", ok_ord).alias("stored_internal_id"))
             .withColumnRenamed(KEY, "_key"))
    if existing is not None:
        first = (first.join(stored_keys(existing).withColumnRenamed(KEY, "_key"), "_key", "left")
                 .withColumn("stored_internal_id", F.coalesce("_old_id", "stored_internal_id")).drop("_old_id"))
    else:
        first = first.withColumn("_old_ts", F.lit(None).cast("timestamp_ntz"))
    own = ["_spread"] if "_spread" in df.columns else ["payload_text", "transaction_ref"]
    spread = F.concat(F.lit("\u0000"), F.xxhash64("_ord", *own).cast("string"))
    j = (df.withColumn("_jk", F.when(has_key, F.col(KEY)).otherwise(spread))
         .join(first, F.col("_jk") == F.col("_key"), "left").drop("_jk", "_key"))
    stored_at = F.coalesce(F.col("_old_ts"), F.col("_first.ts"))
    new = F.col("_old_ts").isNull()
    label = (
        F.when(stored_at.isNull(), F.lit("failed"))
        .when(new & (F.col("_ord") == F.col("_first")), F.lit("stored"))
        .when(new & (F.col("_ord") < F.col("_first")), F.lit("failed"))
        .when(F.col("server_received_at") < _plus(stored_at, ttl_secs), F.lit("duplicate"))
        .when(F.col("ok"), F.lit("ignored_after_ttl"))
        .otherwise(F.lit("failed"))
    )
    return j.withColumn("idem_label", label).drop("_ord", "_first", "_old_ts", "_arrival", "_spread")


def conflicting_duplicates(envelopes: DataFrame) -> DataFrame:
    """IDM-4: keys submitted with more than one distinct payload."""
    text = F.col("payload_text") if "payload_text" in envelopes.columns else F.col("payload").cast("string")
    return (envelopes.filter(F.coalesce(F.col(KEY), F.lit("")) != "")
            .groupBy(KEY)
            .agg(F.countDistinct(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("distinct_payloads"),
                 F.count(F.lit(1)).alias("submissions"))
            .filter("distinct_payloads > 1"))


def idempotency_table(labelled: DataFrame, ttl_secs: int = 24 * 3600) -> DataFrame:
    """T2 rows: one per stored key with its response and expiry."""
    stored = labelled.filter(F.col("idem_label") == "stored")
    return stored.select(
        KEY,
        F.struct(F.col("internal_id"), F.lit(True).alias("success"),
                 F.lit(None).cast("string").alias("error_code"),
                 F.lit(None).cast("string").alias("error_msg"),
                 F.col("server_received_at").alias("stored_at")).alias("response"),
        "source_system",
        _plus(F.col("server_received_at"), ttl_secs).alias("expires_at"),
        F.col("server_received_at").alias("created_at"))


def purge_expired(idem: DataFrame, as_of) -> DataFrame:
    """IDM-3: drop keys whose entry expired at ``as_of``."""
    from ledgermesh.functions.times import as_ts
    return idem.filter(F.col("expires_at") > as_ts(as_of))


def write_keys(idem: DataFrame, path: str) -> None:
    """Append T2 rows to the key table, in folders by their day of expiry."""
    (idem.withColumn("expires_on", F.to_date("expires_at")).hint("rebalance", F.col("expires_on"))
     .write.mode("append").partitionBy("expires_on").parquet(path))


def live_keys(spark, path: str, as_of) -> DataFrame:
    """The key table's entries that have not expired: expired days are pruned, the
    day of ``as_of`` is filtered by the hour."""
    from ledgermesh.functions.times import as_ts
    rows = spark.read.parquet(path)
    return purge_expired(rows.filter(F.col("expires_on") >= F.to_date(as_ts(as_of))), as_of).drop("expires_on")


def purge_expired_days(spark, path: str, as_of) -> list[str]:
    """IDM-3 on the stored key table: delete the folders of days before ``as_of``'s;
    no file is rewritten. Returns the days deleted. Expired entries of the day
    itself go a day later and are filtered by ``live_keys`` until then."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    today = as_of.date().isoformat()
    gone = []
    for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "expires_on=*")) or []:
        day = f.getPath().getName().split("=")[1]
        if day < today:  # ISO days order as text
            fs.delete(f.getPath(), True)
            gone.append(day)
    return sorted(gone)


@dataclass
class IngestResult:
    labelled: DataFrame

    @property
    def records(self) -> DataFrame:
        return P.to_records(self.labelled.filter(F.col("idem_label") == "stored"), only_ok=False)

    @property
    def dlq(self) -> DataFrame:
        return P.route_dlq(self.labelled.filter(F.col("idem_label") == "failed"), only_failed=False)

    def summary(self) -> DataFrame:
        """SRC-9: duplicates count as processed."""
        return self.labelled.agg(
            F.count_if(F.col("idem_label") != "failed").alias("total_processed"),
            F.count_if(F.col("idem_label") == "failed").alias("total_failed"))


def ingest_batch(envelopes: DataFrame, as_of, cfg: IngestConfig | None = None,
                 adapter_type: str | None = None, existing_keys: DataFrame | None = None,
                 checkpoint: bool = False, keep: tuple[str, ...] | None = None) -> IngestResult:
    """SRC-9: pipeline + idempotency for one batch.

    ``existing_keys`` (the stored records, or the idempotency table) makes the
    labels hold across batches as if all were one (SNK-1, IDM-2).
    ``checkpoint=True`` writes the processed batch to the shared checkpoint
    folder first, so the payload is parsed once even though the per-key
    aggregate and the join both read it (use it for large batches). ``keep`` names
    the columns that later steps read beside keys, times and outcomes: counters
    need no payload, so none is written for them. A batch
    without ``row_id`` is always written: its rows are numbered as they arrive,
    and the numbers must not change when a lost task runs again.
    """
    cfg = cfg or IngestConfig()
    processed = P.run_pipeline(envelopes, as_of, cfg, adapter_type=adapter_type)
    if "row_id" not in envelopes.columns:
        processed = processed.withColumn("_arrival", F.monotonically_increasing_id())
        checkpoint = True
    if keep is not None:
        spread = F.xxhash64("payload_text", "transaction_ref").alias("_spread")
        needed = [KEY, "internal_id", "server_received_at", "ok", "row_id", "_arrival"]
        if "row_id" not in processed.columns:  # equal times are ordered by the content
            needed += ["source_system", "payload_text"]
        processed = processed.select(*[c for c in processed.columns if c in {*needed, *keep}], spread)
    if checkpoint:  # parse once: both sides of the key join read the written batch
        processed = processed.checkpoint()
    return IngestResult(label_idempotent(processed, cfg.idempotency_ttl_secs, existing_keys))


def write_records(existing: DataFrame, new_records: DataFrame) -> DataFrame:
    """SNK-1: insert, conflict on idempotency_key ignored: one row per new key
    (the first received, ties to the smaller internal_id), and none whose key is
    already stored (left-anti join)."""
    first = [F.col(c) for c in ("server_received_at", "internal_id") if c in new_records.columns]
    one = new_records.groupBy(KEY).agg(F.min_by(F.struct(*new_records.columns), F.struct(*first)).alias("r")).select("r.*")
    fresh = one.join(existing.select(KEY), KEY, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def dlq_replay(dlq: DataFrame, as_of, cfg: IngestConfig | None = None, max_retries: int = 3,
               existing_keys: DataFrame | None = None):
    """RT-5: re-run the pipeline on retryable DLQ rows. Returns
    ``(recovered_records, remaining_dlq)``: successes leave the DLQ, failures
    stay with ``retry_count + 1``; exhausted rows are kept untouched."""
    from ledgermesh.functions.times import as_ts
    retryable = dlq.filter(F.col("retry_count") < int(max_retries))
    exhausted = dlq.filter(F.col("retry_count") >= int(max_retries))
    env = retryable.select(KEY, "transaction_ref", "source_system", "adapter_type",
                           F.col("raw_payload").cast("string").alias("payload_text"),
                           F.col("created_at").alias("server_received_at"), "retry_count")
    res = ingest_batch(env, as_of, cfg, existing_keys=existing_keys)
    recovered = res.records
    still = res.labelled.filter(F.col("idem_label") == "failed").select(
        KEY, "transaction_ref", "source_system", "adapter_type",
        F.coalesce(F.col("raw_payload"), F.col("payload_text").cast("binary")).alias("raw_payload"),
        "error_stage", "error_reason",
        "error_message", (F.col("retry_count") + 1).alias("retry_count"),
        F.col("server_received_at").alias("created_at"), as_ts(as_of).alias("last_attempt_at"))
    return recovered, exhausted.unionByName(still.select(*exhausted.columns))
