"""Ingest pipeline: enrich -> validate -> normalize -> validate fields (PRJ, VAL, NRM, SNK-2).

Every stage is a narrow ``DataFrame -> DataFrame`` transform; no stage shuffles.
A record's *first* failing rule is kept by one ``CASE`` ladder per stage,
so a failed row carries ``error_stage``, ``error_reason``, ``error_message``
and later stages leave it alone (the reference stops at the first error).

Envelope columns (T0): ``idempotency_key, transaction_ref, source_system,
payload_text`` (or ``payload`` bytes), optional ``adapter_type, trace_id,
tags map<string,string>, server_received_at, payload_schema``.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from ledgermesh.config import IngestConfig
from ledgermesh.functions.amounts import AMOUNT_SQL, amount_error, parse_amount
from ledgermesh.functions.times import as_ts, parse_event_time

# Currencies the validator accepts, and the transaction_ref pattern.
VALID_CURRENCIES = ("INR", "USD", "EUR", "GBP", "JPY", "AUD", "CAD", "CHF", "CNY", "SGD", "AED", "MYR")
TXREF_PATTERN = r"^[\x20-\x7E]+\z"
ADAPTER_TYPES = ("grpc", "rest", "webhook", "kafka", "file", "db_poll")  # adapter_type values

_EMPTY_TAGS = "map<string,string>"


def _col_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def _tag_put(tags: Column, key: str, value: Column) -> Column:
    """Set ``key`` (overwrites); NULL ``value`` leaves the map unchanged."""
    without = F.map_filter(tags, lambda k, v: k != F.lit(key))
    return F.when(value.isNull(), tags).otherwise(
        F.map_concat(without, F.create_map(F.lit(key), value)))


def _tag_merge_low(tags: Column, extra: Column) -> Column:
    """Add entries of ``extra`` whose keys are not in ``tags`` (existing win).

    The per-entry filter (an interpreted lambda) only runs when the key sets
    overlap; the common case is a plain ``map_concat``.
    """
    empty = F.create_map().cast(_EMPTY_TAGS)
    ex = F.coalesce(extra, empty)
    keep = F.when(F.size(ex) == 0, empty) \
        .when(F.arrays_overlap(F.map_keys(ex), F.map_keys(tags)),
              F.map_filter(ex, lambda k, v: ~F.array_contains(F.map_keys(tags), k))) \
        .otherwise(ex)
    return F.map_concat(tags, keep)


def _tag_override(tags: Column, new: Column, new_keys: list[str]) -> Column:
    """``tags`` with ``new`` (keys among ``new_keys``) taking precedence."""
    keys = F.array(*[F.lit(k) for k in new_keys])
    base = F.when(F.size(new) == 0, tags) \
        .when(F.arrays_overlap(F.map_keys(tags), keys),
              F.map_filter(tags, lambda k, v: ~k.isin(*new_keys))) \
        .otherwise(tags)
    return F.map_concat(base, new)


def enrich(envelopes: DataFrame, adapter_type: str | None = None, received_at=None) -> DataFrame:
    """PRJ-1 + PRJ-2: record skeleton with server stamp, tags and payload text.

    ``server_received_at`` is the landed time column when present, else
    ``received_at`` (a literal; callers pass the batch time), else now.
    The payload is parsed once into ``_v`` (VARIANT) for the later stages.
    NRM-8: an empty envelope ref is filled from the payload (the adapters peek it).
    """
    df = envelopes
    payload_text = _col_or(df, "payload_text", F.lit(None).cast("string"))
    if "payload_text" not in df.columns and "payload" in df.columns:
        payload_text = F.col("payload").cast("string")
    # the raw bytes are carried only when they came as bytes; otherwise they
    # are the text's UTF-8 bytes and are derived where records/DLQ rows are
    # written, so a checkpointed batch does not hold the payload twice
    payload_bin = F.col("payload") if "payload" in df.columns else F.lit(None).cast("binary")
    adapter = F.lit(adapter_type) if adapter_type else _col_or(df, "adapter_type", F.lit("grpc"))
    if "server_received_at" in df.columns:
        received = F.col("server_received_at").cast("timestamp_ntz")
    elif received_at is not None:
        received = as_ts(received_at)
    else:
        received = F.localtimestamp()
    tags0 = F.coalesce(_col_or(df, "tags", F.create_map().cast(_EMPTY_TAGS)).cast(_EMPTY_TAGS),
                       F.create_map().cast(_EMPTY_TAGS))
    passthrough = [c for c in ("row_id", "retry_count") if c in df.columns]
    base = df.select(
        *passthrough,
        F.coalesce(F.col("idempotency_key"), F.lit("")).alias("idempotency_key"),
        _col_or(df, "transaction_ref", F.lit(None).cast("string")).alias("_ref"),
        F.coalesce(F.col("source_system"), F.lit("")).alias("source_system"),
        adapter.alias("adapter_type"),
        payload_bin.alias("raw_payload"),
        payload_text.alias("payload_text"),
        _col_or(df, "payload_schema", F.lit(None).cast("string")).alias("payload_schema"),
        _col_or(df, "trace_id", F.lit(None).cast("string")).alias("trace_id"),
        received.alias("server_received_at"),
        tags0.alias("_tags0"),
        F.try_parse_json(payload_text).alias("_v"),
    )
    # valid JSON whose first character after JSON's white space (blank, tab,
    # line ends) is '{' is an object; cheaper than rendering the variant's schema
    is_obj = F.col("_v").isNotNull() & F.coalesce(F.ltrim(F.col("payload_text"), F.lit(" \t\r\n")).startswith("{"),
                                                  F.lit(False))
    base = base.withColumn("_is_obj", is_obj)
    peek_ref = F.when(F.col("_is_obj"), F.try_variant_get("_v", "$.transaction_ref", "string"))
    cols = [c for c in base.columns if c not in ("_ref", "_tags0")]
    return base.select(
        *cols,
        F.coalesce(F.nullif(F.col("_ref"), F.lit("")), F.nullif(peek_ref, F.lit("")), F.lit(""))
        .alias("transaction_ref"),
        _tag_override(F.col("_tags0"), F.create_map(F.lit("adapter_type"), F.col("adapter_type")),
                      ["adapter_type"]).alias("tags"),
    )


def _fail(df: DataFrame, stage: str, ladder: list[tuple[Column, str, Column]]) -> DataFrame:
    """Add one independent check column per rule: ``struct(stage, reason,
    message)`` when the rule fails, else NULL. ``finalize_errors`` keeps the
    first failing rule in order. Checks never read each other, so the plan
    stays linear in the number of rules."""
    n = sum(1 for c in df.columns if c.startswith("_chk_"))
    cols = []
    for i, (cond, why, msg) in enumerate(ladder):
        cols.append(F.when(cond, F.struct(F.lit(stage).alias("stage"), F.lit(why).alias("reason"),
                                          msg.alias("message"))).alias(f"_chk_{n + i:03d}"))
    return df.select("*", *cols)


def finalize_errors(df: DataFrame) -> DataFrame:
    """First failing check -> ``error_stage``, ``error_reason``, ``error_message``, ``ok``."""
    checks = sorted(c for c in df.columns if c.startswith("_chk_"))
    first = F.coalesce(*[F.col(c) for c in checks]) if checks else F.lit(None)
    rest = [c for c in df.columns if not c.startswith("_chk_") and c not in ("error_stage", "error_reason", "error_message")]
    out = df.select(*rest, first.alias("_err"))
    return out.select(*rest, F.col("_err.stage").alias("error_stage"), F.col("_err.reason").alias("error_reason"),
                      F.col("_err.message").alias("error_message"), F.col("_err").isNull().alias("ok"))


def validate_envelope(df: DataFrame, cfg: IngestConfig | None = None) -> DataFrame:
    """VAL-1..5: required fields, ref format, payload size."""
    cfg = cfg or IngestConfig()
    size = F.coalesce(F.octet_length("raw_payload"), F.octet_length("payload_text"), F.lit(0))
    return _fail(df, "validate", [
        (F.col("idempotency_key") == "", "missing_field", F.lit("idempotency_key is required")),
        (F.col("transaction_ref") == "", "missing_field", F.lit("transaction_ref is required")),
        (F.col("source_system") == "", "missing_field", F.lit("source_system is required")),
        (~F.col("transaction_ref").rlike(TXREF_PATTERN), "invalid_format",
         F.lit("transaction_ref contains non-printable characters")),
        (size > cfg.max_payload_bytes, "payload_too_large",
         F.format_string("payload size %d bytes exceeds limit %d", size, F.lit(cfg.max_payload_bytes))),
    ])


def normalize(df: DataFrame, cfg: IngestConfig | None = None) -> DataFrame:
    """NRM-1..7 over the payload JSON (parsed once by ``enrich``).

    Empty payload: nothing parsed. Non-JSON (or, with ``parity``, a numeric
    amount) -> tag ``parse_warning=non_json_payload``. Amount text must be a
    plain decimal that fits DECIMAL(22,6) (D19), else the row fails.
    Each step is its own projection so no parse is evaluated twice.
    """
    cfg = cfg or IngestConfig()
    non_empty = F.coalesce(F.length("payload_text"), F.lit(0)) > 0
    string_fields_ok = F.lit(True)
    if cfg.parity:  # the reference's decoder only takes strings (or null) for these fields
        for name in ("amount", "currency", "event_time", "schema"):
            kind = F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))
            string_fields_ok = string_fields_ok & F.coalesce(kind, F.lit("VOID")).isin("STRING", "VOID")
    df = df.withColumn("_usable", non_empty & F.col("_is_obj") & string_fields_ok) \
           .withColumn("_warn", non_empty & ~F.col("_usable"))

    def field(name):
        return F.when(F.col("_usable"), F.nullif(F.try_variant_get("_v", f"$.{name}", "string"), F.lit("")))

    df = df.select(
        "*",
        field("amount").alias("amount_text"),
        F.upper(F.trim(field("currency"))).alias("currency"),
        field("event_time").alias("_ev_txt"),
        field("schema").alias("_schema"),
        F.when(F.col("_usable"), F.try_variant_get("_v", "$.extra", "map<string,string>")).alias("_extra"),
    )
    df = df.select("*", parse_event_time(F.col("_ev_txt")).alias("record_timestamp"),
                   parse_amount(F.col("amount_text")).alias("amount"),
                   amount_error(F.col("amount_text")).alias("_amount_err"))
    # tags: warnings overwrite, extra fields only fill missing keys
    bad_time = F.col("_ev_txt").isNotNull() & F.col("record_timestamp").isNull()
    warn_map = (F.when(F.col("_warn") & bad_time,
                       F.create_map(F.lit("parse_warning"), F.lit("non_json_payload"),
                                    F.lit("raw_event_time"), F.col("_ev_txt")))
                .when(F.col("_warn"), F.create_map(F.lit("parse_warning"), F.lit("non_json_payload")))
                .when(bad_time, F.create_map(F.lit("raw_event_time"), F.col("_ev_txt")))
                .otherwise(F.create_map().cast(_EMPTY_TAGS)))
    df = df.withColumn("_tags1", _tag_override(F.col("tags"), warn_map, ["parse_warning", "raw_event_time"]))
    df = df.withColumn("_tags2", _tag_merge_low(F.col("_tags1"), F.col("_extra")))
    df = (df.withColumn("payload_schema", F.coalesce("_schema", "payload_schema"))
          .withColumn("tags", F.col("_tags2")))
    err = F.col("_amount_err")
    out = _fail(df, "normalize", [
        (err == "invalid_amount", "invalid_amount",
         F.format_string("cannot parse amount \"%s\"", F.col("amount_text"))),
        (err == "amount_precision", "amount_precision",
         F.format_string("amount \"%s\" needs more than 16 integer or 6 fraction digits", F.col("amount_text"))),
    ])
    return out.drop("_usable", "_warn", "_ev_txt", "_schema", "_extra", "_amount_err", "_tags1", "_tags2")


def validate_fields(df: DataFrame, as_of, cfg: IngestConfig | None = None) -> DataFrame:
    """VAL-6..8 after normalisation (D5): currency code, clock skew, sign."""
    cfg = cfg or IngestConfig()
    limit = as_ts(as_of) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(cfg.clock_skew_secs))
    cur = F.col("currency")
    return _fail(df, "validate", [
        (cur.isNotNull() & (cur != "") & ~cur.isin(*VALID_CURRENCIES), "invalid_currency",
         F.format_string("currency \"%s\" is not a recognised ISO 4217 code", cur)),
        (F.col("record_timestamp").isNotNull() & (F.col("record_timestamp") > limit), "future_timestamp",
         F.format_string("record timestamp %s is more than 5m0s in the future",
                         F.date_format("record_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
        (F.col("amount").isNotNull() & (F.col("amount") < 0), "negative_amount",
         F.format_string("amount must be non-negative, got %s", F.col("amount_text"))),
    ])


def internal_id_for(key: Column) -> Column:
    """Deterministic record id from the idempotency key (PRJ-2), UUID-shaped."""
    h = F.sha2(key, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def run_pipeline(envelopes: DataFrame, as_of, cfg: IngestConfig | None = None,
                 adapter_type: str | None = None) -> DataFrame:
    """All stages in order; every input row comes out once, failed or not."""
    cfg = cfg or IngestConfig()
    df = enrich(envelopes, adapter_type=adapter_type, received_at=as_of)
    df = validate_envelope(df, cfg)
    df = normalize(df, cfg)
    if not cfg.parity:  # D5: the reference validates before normalising, so these never fire there
        df = validate_fields(df, as_of, cfg)
    out = finalize_errors(df.drop("_v", "_is_obj")) \
        .withColumn("internal_id", internal_id_for(F.col("idempotency_key")))
    if cfg.parity:  # D7: missing amount stored as '0', currency as ''
        out = out.withColumn("amount", F.coalesce("amount", F.lit(0).cast(AMOUNT_SQL))) \
                 .withColumn("currency", F.coalesce("currency", F.lit("")))
    return out


RECORD_COLUMNS = ("internal_id", "idempotency_key", "transaction_ref", "source_system", "adapter_type",
                  "amount", "amount_text", "currency", "record_timestamp", "server_received_at",
                  "payload_schema", "tags", "trace_id")


def _raw_payload() -> Column:
    return F.coalesce(F.col("raw_payload"), F.col("payload_text").cast("binary")).alias("raw_payload")


def to_records(processed: DataFrame, status: str = "PENDING", only_ok: bool = True) -> DataFrame:
    """T1 rows of successful submissions."""
    rows = processed.filter("ok") if only_ok else processed
    return rows.select(*RECORD_COLUMNS, _raw_payload(), F.lit(status).alias("status"),
                                         F.col("server_received_at").alias("created_at"))


def route_dlq(processed: DataFrame, only_failed: bool = True) -> DataFrame:
    """SNK-2: failed rows with stage/reason/message (T3)."""
    rows = processed.filter(~F.col("ok")) if only_failed else processed
    return rows.select(
        "idempotency_key", "transaction_ref", "source_system", "adapter_type", _raw_payload(),
        "error_stage", "error_reason", "error_message",
        F.lit(0).alias("retry_count"), F.col("server_received_at").alias("created_at"),
        F.col("server_received_at").alias("last_attempt_at"))
