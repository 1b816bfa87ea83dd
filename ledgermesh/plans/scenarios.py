"""Multi-step engine runs over F1, used by the registered queries and tests.

Two passes: pass 1 sees all records except non-ERP records of refs with
k % 4 = 0 and payment records of refs with k % 4 = 1; pass 2 sees all.
Refs with k % 4 = 0 are PENDING after pass 1 and decided in pass 2; refs with
k % 4 = 1 are decided in pass 1 and their late payment record is ignored
(D9) until a retrigger, which runs over every ref.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgermesh.config import MatchRules
from ledgermesh.operators.matching import REF
from ledgermesh.plans import fixtures as FX
from ledgermesh.plans.batch import ReconTables, reconcile_batch, retrigger

# Fixed values of the scenario.
PASS1_AS_OF = dt.datetime(2025, 1, 1)
PASS2_AS_OF = dt.datetime(2025, 1, 2)
RETRIGGER_AS_OF = dt.datetime(2025, 1, 3)
RULES = MatchRules(strategy="tolerance", abs_tolerance="0.05", pct_tolerance=0.01, pending_timeout_secs=None)


def order_key(ref="transaction_ref"):
    return F.substring(F.col(ref), 5, 32).try_cast("bigint")


def _late():
    k4 = order_key() % 4
    return ((F.col("source_system") != "erp_system") & (k4 == 0)) | \
           ((F.col("source_system") == "payment_gateway") & (k4 == 1))


def pass1_records(records):
    return records.filter(~_late())


def late_records(records):
    return records.filter(_late())


def first_pass(spark, sf_dir):
    t0 = ReconTables.fresh(spark, pass1_records(FX.f1_records(spark, sf_dir)))
    return reconcile_batch(t0, RULES, PASS1_AS_OF, batch_id="pass1", materialize=True)


def two_pass(spark, sf_dir):
    recs = FX.f1_records(spark, sf_dir)
    p1 = first_pass(spark, sf_dir)
    t1 = ReconTables(recs, p1.tables.state, p1.tables.details, p1.tables.audit)
    p2 = reconcile_batch(t1, RULES, PASS2_AS_OF, batch_id="pass2", materialize=True)
    return p1, p2


def after_retrigger(spark, sf_dir):
    _, p2 = two_pass(spark, sf_dir)
    return retrigger(p2.tables, p2.tables.state.select(REF), RULES, RETRIGGER_AS_OF, batch_id="retrigger")


# ── F4: state derived from reconcile(F1), retry queue, manual decisions ──────
from ledgermesh.functions.amounts import AMOUNT_SQL  # noqa: E402
from ledgermesh.functions.times import as_ts  # noqa: E402
from ledgermesh.plans.fixtures import F1_AS_OF, table  # noqa: E402

F4_AS_OF = F1_AS_OF
RETRY_AS_OF = F1_AS_OF


def f4_tables(spark, sf_dir):
    """State, details and audit after one batch over all of F1 (checkpointed:
    later steps read the written snapshot, not the lineage)."""
    out = reconcile_batch(ReconTables.fresh(spark, FX.f1_records(spark, sf_dir)), RULES, F4_AS_OF, batch_id="f4",
                          materialize=True)
    return out.tables


def f4_queue(state):
    """MISMATCHED refs with attempt_count = k%6, max 5, due at as_of + (k%7-3) min,
    status by k%9 (0 EXHAUSTED, 1 RESOLVED, else PENDING)."""
    k = order_key()
    now = as_ts(RETRY_AS_OF)
    return state.filter(F.col("status") == "MISMATCHED").select(
        REF, (k % 6).cast("int").alias("attempt_count"), F.lit(5).alias("max_attempts"),
        F.lit(None).cast("timestamp_ntz").alias("last_attempted_at"),
        (now + F.make_dt_interval(F.lit(0), F.lit(0), (k % 7 - 3).cast("int"), F.lit(0))).alias("next_retry_at"),
        F.when(k % 9 == 0, F.lit("EXHAUSTED")).when(k % 9 == 1, F.lit("RESOLVED")).otherwise(F.lit("PENDING"))
        .alias("status"),
        F.lit("api").alias("requested_by"), now.alias("created_at"), now.alias("updated_at"))


def corrections(spark, sf_dir):
    """Vendor re-sends the right amount (k%7=1, vendor present, k even), 600 s later."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.filter((k % 7 == 1) & (k % 10 != 9) & (k % 2 == 0)).select(
        F.concat(F.lit("ORD-"), k.cast("string")).alias("transaction_ref"),
        F.lit("vendor_portal").alias("source_system"),
        F.concat(F.lit("venfix-"), k.cast("string")).alias("internal_id"),
        F.col("o_totalprice").cast(AMOUNT_SQL).alias("amount"), F.lit("USD").alias("currency"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(600)))
        .cast("timestamp_ntz").alias("server_received_at"))


def f4_decisions(state):
    """Every third MISMATCHED ref -> erp_system; PENDING refs with k%100=9 and
    unknown refs (rejected)."""
    k = order_key()
    mism = state.filter((F.col("status") == "MISMATCHED") & (k % 3 == 0))
    pend = state.filter((F.col("status") == "PENDING") & (k % 100 == 9))
    unknown = state.filter(k % 500 == 0).select(F.concat(F.lit("UNKNOWN-"), F.col(REF)).alias(REF))
    cols = [F.lit("erp_system").alias("chosen_source"), F.lit("tester").alias("resolver_id"),
            F.lit("manual review").alias("reason")]
    return mism.select(REF, *cols).unionByName(pend.select(REF, *cols)).unionByName(unknown.select(REF, *cols))
