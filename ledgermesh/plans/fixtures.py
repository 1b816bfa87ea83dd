"""Inputs derived from the given tables (``orders``, ``events``).

Every fixture is a Spark plan over the parquet tables, so its size grows with
the scale factor. ``sf_dir`` is a folder holding ``<table>.parquet``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermesh.functions.amounts import AMOUNT_SQL

# Fixed values of the derived fixtures.
F1_AS_OF = dt.datetime(2025, 1, 1)
F2_AS_OF = dt.datetime(2025, 1, 1)
SOURCES_BY_K3 = ("erp_system", "vendor_portal", "payment_gateway")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _secs(c, n: int):
    return c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))


def f1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """up to three sources per order, some with superseded submissions."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_totalprice").cast(AMOUNT_SQL).alias("p"),
        F.col("o_orderdate").alias("d"))
    k, p, d = F.col("k"), F.col("p"), F.col("d")

    def dec(x):
        return F.lit(x).cast(AMOUNT_SQL)

    def row(when, source, prefix, amount, currency, ts):
        made = F.struct(F.lit(source).alias("source_system"),
                        F.concat(F.lit(prefix), k.cast("string")).alias("internal_id"),
                        amount.cast(AMOUNT_SQL).alias("amount"), currency.alias("currency"),
                        ts.cast("timestamp_ntz").alias("server_received_at"))
        return made if when is None else F.when(when, made)

    rows = F.array(  # one scan of the orders; a source that does not report an order is null
        row(None, "erp_system", "erp-", p, F.lit("USD"), d),
        row(k % 10 != 9, "vendor_portal", "ven-",
            F.when(k % 7 == 0, p + dec("0.03")).when(k % 7 == 1, p + dec("250")).otherwise(p),
            F.when(k % 97 == 0, F.lit("EUR")).otherwise(F.lit("USD")), _secs(d, 60)),
        row((k % 13 == 0) & (k % 10 != 9), "vendor_portal", "ven0-", p + dec("999"), F.lit("USD"), _secs(d, 30)),
        row((k % 10).isin(0, 1, 2, 3, 4, 5), "payment_gateway", "pay-",
            F.when(k % 11 == 0, p - dec("99.99")).otherwise(p), F.lit("USD"), _secs(d, 120)))
    return (o.select("k", F.explode(rows).alias("r")).filter("r is not null")
            .select(F.concat(F.lit("ORD-"), F.col("k").cast("string")).alias("transaction_ref"), "r.*"))


def f3_event_records(spark: SparkSession, sf_dir: str, null_every: int | None = None) -> DataFrame:
    """the ``events`` table as a five-source stream; the user is the ref.

    ``null_every`` blanks the amount of every n-th event (majority null paths).
    """
    e = table(spark, sf_dir, "events")
    amount = F.col("value").cast(AMOUNT_SQL)
    if null_every:
        amount = F.when(F.col("event_id") % null_every == 0, F.lit(None).cast(AMOUNT_SQL)).otherwise(amount)
    return e.select(
        F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("transaction_ref"),
        F.col("event_type").alias("source_system"),
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("internal_id"),
        amount.alias("amount"), F.lit("USD").alias("currency"),
        F.col("ts").cast("timestamp_ntz").alias("server_received_at"))


# F2 fault rules, first match wins (fixed values of the fixture).
F2_RULES = (
    (101, "nokey"), (103, "noref"), (109, "nosrc"), (107, "bell"), (113, "notjson"),
    (127, "num"), (131, "comma"), (137, "neg"), (139, "xxx"), (149, "noamt"),
    (151, "yday"), (157, "future"),
)
F2_COPIES = ((0, 0, None), (1, 3600, 19), (2, 90000, 17))  # (copy, +seconds, when k % n == 0)
F2_CONFLICT = 7  # copies of these orders name another schema in their payload


def f2_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw submissions with faults and re-sent copies (one per order + copies)."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("tp"), F.col("o_orderdate").alias("d"))
    k = F.col("k")
    rule = F.lit("ok")
    for n, name in reversed(F2_RULES):
        rule = F.when(k % n == 0, F.lit(name)).otherwise(rule)
    o = o.withColumn("rule", rule)
    rule = F.col("rule")
    price = F.col("tp").cast("decimal(12,2)").cast("string")
    amount_part = (F.when(rule == "num", F.concat(F.lit('"amount":'), price, F.lit(",")))
                   .when(rule == "comma", F.lit('"amount":"12,50",'))
                   .when(rule == "neg", F.lit('"amount":"-5.00",'))
                   .when(rule == "noamt", F.lit(""))
                   .otherwise(F.concat(F.lit('"amount":"'), price, F.lit('",'))))
    currency_part = F.when(rule == "xxx", F.lit('"currency":"XXX",')).otherwise(F.lit('"currency":" usd ",'))
    event_part = (F.when(rule == "yday", F.lit('"event_time":"yesterday",'))
                  .when(rule == "future", F.lit('"event_time":"2999-01-01T00:00:00Z",'))
                  .otherwise(F.lit('"event_time":"2024-01-15T10:30:00Z",')))
    payload = F.when(rule == "notjson", F.lit("not json")).otherwise(F.concat(
        F.lit("{"), amount_part, currency_part, event_part,
        F.lit('"schema":"invoice.v1.json","extra":{"region":"IN"}}')))
    kt = k.cast("string")
    base = o.select(
        k, F.col("d"),
        F.when(rule == "nokey", F.lit("")).otherwise(F.concat(F.lit("key-"), kt)).alias("idempotency_key"),
        F.when(rule == "noref", F.lit(""))
        .when(rule == "bell", F.concat(F.lit("ORD-"), kt, F.lit("\u0007")))
        .otherwise(F.concat(F.lit("ORD-"), kt)).alias("transaction_ref"),
        F.when(rule == "nosrc", F.lit(""))
        .otherwise(F.element_at(F.array(*[F.lit(s) for s in SOURCES_BY_K3]), (k % 3 + 1).cast("int")))
        .alias("source_system"),
        F.when(k % 2 == 0, F.lit("file")).otherwise(F.lit("webhook")).alias("adapter_type"),
        payload.alias("payload_text"))
    again = F.when(k % F2_CONFLICT == 0, F.replace("payload_text", F.lit("invoice.v1"), F.lit("invoice.v2"))) \
        .otherwise(F.col("payload_text"))
    copies = [F.struct((k * 10 + copy).alias("row_id"), _secs(F.col("d"), secs).cast("timestamp_ntz").alias("at"),
                       (again if copy else F.col("payload_text")).alias("payload_text"))
              for copy, secs, _ in F2_COPIES]
    sent = F.array(*[c if every is None else F.when(k % every == 0, c)
                     for c, (_, _, every) in zip(copies, F2_COPIES, strict=True)])
    return base.withColumn("c", F.explode(sent)).filter("c is not null").select(
        "c.row_id", "idempotency_key", "transaction_ref", "source_system", "adapter_type", "c.payload_text",
        F.col("c.at").alias("server_received_at"))


def f2_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 with other bodies: none at all (k % 5 = 0), the ref in the payload only
    (k % 3 = 1), or extra fields that clash with tags the pipeline sets."""
    f2 = f2_envelopes(spark, sf_dir)
    k = F.floor(F.col("row_id") / 10)
    empty, inside = k % 5 == 0, k % 3 == 1
    head = F.concat(F.lit('{"transaction_ref":"PAY-'), k.cast("string"), F.lit('",'))
    clash = F.lit('"extra":{"adapter_type":"other","region":"IN"}')
    text = F.replace(F.col("payload_text"), F.lit('"extra":{"region":"IN"}'), clash)
    return f2.withColumn("payload_text", F.when(empty, F.lit("")).when(
        inside, F.regexp_replace("payload_text", r"^\{", head)).otherwise(text)).withColumn(
        "transaction_ref", F.when(inside, F.lit("")).otherwise(F.col("transaction_ref")))
