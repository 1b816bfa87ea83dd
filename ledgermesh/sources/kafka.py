"""Kafka-shaped rows (SRC-6) -> envelopes.

Works on ``spark.readStream.format("kafka")`` output (``key, value, topic,
partition, offset, headers`` with ``includeHeaders``) and on any DataFrame of
that shape. Start at the latest offset, as the reference does:
``.option("startingOffsets", "latest")``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _header(name: str) -> F.Column:
    hit = F.filter(F.coalesce(F.col("headers"), F.array().cast("array<struct<key:string,value:binary>>")),
                   lambda h: h["key"] == F.lit(name))
    return F.get(hit, 0)["value"].cast("string")


def from_kafka(messages: DataFrame, source_system: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(envelopes, rejected)``; an empty value is rejected.

    key: payload ``idempotency_key`` -> message key -> ``kafka-topic-partition-offset``;
    source: configured -> payload ``source_system`` -> ``kafka-unknown``;
    trace id: header ``X-Trace-Id`` then ``trace_id``; tags carry topic,
    partition and offset.
    """
    text = F.col("value").cast("string")
    has_headers = "headers" in messages.columns
    m = messages.withColumn("_text", text)
    empty = F.coalesce(F.length("_text"), F.lit(0)) == 0
    rejected = m.filter(empty).select("topic", "partition", "offset",
                                      F.lit("empty message value").alias("reason"))
    ok = m.filter(~empty)
    payload_key = F.nullif(F.get_json_object("_text", "$.idempotency_key"), F.lit(""))
    msg_key = F.nullif(F.col("key").cast("string"), F.lit(""))
    default_key = F.format_string("kafka-%s-%d-%d", F.col("topic"), F.col("partition"), F.col("offset"))
    src = F.lit(source_system) if source_system else F.coalesce(
        F.nullif(F.get_json_object("_text", "$.source_system"), F.lit("")), F.lit("kafka-unknown"))
    trace = F.coalesce(_header("X-Trace-Id"), _header("trace_id")) if has_headers else F.lit(None).cast("string")
    env = ok.select(
        F.coalesce(payload_key, msg_key, default_key).alias("idempotency_key"),
        F.coalesce(F.get_json_object("_text", "$.transaction_ref"), F.lit("")).alias("transaction_ref"),
        src.alias("source_system"), F.lit("kafka").alias("adapter_type"),
        F.col("_text").alias("payload_text"), F.lit(None).cast("string").alias("payload_schema"),
        trace.alias("trace_id"),
        F.create_map(F.lit("kafka_topic"), F.col("topic"),
                     F.lit("kafka_partition"), F.col("partition").cast("string"),
                     F.lit("kafka_offset"), F.col("offset").cast("string")).alias("tags"))
    return env, rejected
