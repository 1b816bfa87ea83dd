"""Webhook bodies (SRC-4): one landed request body -> one row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgermesh.sources.files import generated_key, numbered

_EMPTY_TAGS = "map<string,string>"


def _trimmed(body_col: str) -> Column:
    return F.trim(F.col(body_col), F.lit(" \t\r\n"))  # JSON's white space


def _bad_array(b: Column) -> Column:
    return b.startswith("[") & F.from_json(b, "array<string>").isNull()


def explode_bodies(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per record: a body that is a JSON array yields its elements, a
    JSON object (on one line or many) itself, any other body its non-blank
    lines (NDJSON; also where it starts with ``{``, unlike the reference, which
    takes that as one object). Arrays that do not parse: ``rejected_bodies``.

    Input columns: ``source_system``, optional ``trace_id`` and ``request_id``,
    ``body``. A record without a key gets one from its request and position;
    without ``request_id`` equal bodies are numbered (a stream needs the column).
    """
    trace = F.col("trace_id") if "trace_id" in bodies.columns else F.lit(None).cast("string")
    cols = ["source_system", "trace_id", "_body"]
    rows = bodies.select(F.col("source_system"), trace.alias("trace_id"), _trimmed(body_col).alias("_body"),
                         *[c for c in ("request_id",) if c in bodies.columns])
    if "request_id" not in rows.columns:
        if rows.isStreaming:
            raise ValueError("a stream of bodies needs request_id")
        rows = numbered(rows, cols).withColumn("request_id", F.concat_ws(
            "|", F.coalesce("trace_id", F.lit("")), "_body", F.col("_nth").cast("string")))
    b = F.col("_body")
    # in brackets, one JSON value is an array of one and several lines do not parse
    single = F.from_json(F.concat(F.lit("["), b, F.lit("]")), "array<string>")
    items = (F.when(b.startswith("["), F.from_json(b, "array<string>"))
             .when(b.startswith("{") & (F.size(single) == 1), F.array(b))
             .otherwise(F.split(b, r"\r?\n")))
    rows = rows.select("source_system", "trace_id", "request_id", F.posexplode(items).alias("_pos", "payload_text"))
    rows = rows.filter(F.length(F.trim(F.coalesce("payload_text", F.lit("")))) > 0)
    return rows.select(
        F.coalesce(F.nullif(F.get_json_object("payload_text", "$.idempotency_key"), F.lit("")),
                   generated_key("source_system", "request_id", F.col("_pos").cast("string"))).alias("idempotency_key"),
        F.coalesce(F.get_json_object("payload_text", "$.transaction_ref"), F.lit("")).alias("transaction_ref"),
        "source_system", F.lit("webhook").alias("adapter_type"), "payload_text",
        F.lit(None).cast("string").alias("payload_schema"), "trace_id",
        F.create_map().cast(_EMPTY_TAGS).alias("tags"))


def rejected_bodies(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """The bodies that start as an array and do not parse as one, unchanged, with
    ``error_reason`` (the reference answers them with an error)."""
    return bodies.filter(_bad_array(_trimmed(body_col))).withColumn("error_reason", F.lit("json_array"))
