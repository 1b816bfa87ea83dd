"""Registered queries: one per operator of the inventory, each fed from the
derived fixtures, plus the DuckDB statement of the same query.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``.
Array results are rendered as comma-joined text so both engines compare as
plain values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermesh.config import MatchRules
from ledgermesh.operators import matching as M
from ledgermesh.plans import fixtures as FX
from ledgermesh.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def state_report(rec: M.Reconciliation) -> DataFrame:
    return rec.decisions().select(
        M.REF, "status", "reason", "record_count", "source_count",
        F.array_join("matched_sources", ",").alias("matched_sources"),
        F.array_join("mismatched_sources", ",").alias("mismatched_sources"),
        "reference_amount", "currency")


def details_report(rec: M.Reconciliation) -> DataFrame:
    return rec.details().select(M.REF, "system_name", "internal_id", "amount", "currency",
                                "discrepancy_found", "discrepancy_details")


# ── matching ──────────────────────────────────────────────────────────────
F1_RULES = MatchRules(strategy="tolerance", abs_tolerance="0.05", pct_tolerance=0.01,
                      pending_timeout_secs=None)
F1_EXACT = MatchRules(strategy="exact", pending_timeout_secs=None)
F1_EXPECTED = MatchRules(strategy="tolerance", abs_tolerance="0.05", pct_tolerance=0.01,
                         expected_sources=("erp_system", "vendor_portal", "payment_gateway"),
                         pending_timeout_secs=300)
F1_TIMEOUT_AS_OF = dt.datetime(1998, 1, 1)
F3_MAJORITY = MatchRules(strategy="majority", abs_tolerance="8.00", pending_timeout_secs=None)
F3_NULL_EVERY = 29


@register("mt00_reconcile_tolerance", O.state_report_sql(O.F1_CTE, "f1", F1_RULES, FX.F1_AS_OF))
def mt00_reconcile_tolerance(spark, sf_dir):
    return state_report(M.reconcile(FX.f1_records(spark, sf_dir), F1_RULES, FX.F1_AS_OF))


@register("mt14_match_details", O.details_report_sql(O.F1_CTE, "f1", F1_RULES, FX.F1_AS_OF))
def mt14_match_details(spark, sf_dir):
    return details_report(M.reconcile(FX.f1_records(spark, sf_dir), F1_RULES, FX.F1_AS_OF))


@register("mt08_exact", O.state_report_sql(O.F1_CTE, "f1", F1_EXACT, FX.F1_AS_OF))
def mt08_exact(spark, sf_dir):
    return state_report(M.reconcile(FX.f1_records(spark, sf_dir), F1_EXACT, FX.F1_AS_OF))


@register("mt08_exact_details", O.details_report_sql(O.F1_CTE, "f1", F1_EXACT, FX.F1_AS_OF))
def mt08_exact_details(spark, sf_dir):
    return details_report(M.reconcile(FX.f1_records(spark, sf_dir), F1_EXACT, FX.F1_AS_OF))


@register("mt04_expected_timeout", O.state_report_sql(O.F1_CTE, "f1", F1_EXPECTED, F1_TIMEOUT_AS_OF))
def mt04_expected_timeout(spark, sf_dir):
    return state_report(M.reconcile(FX.f1_records(spark, sf_dir), F1_EXPECTED, F1_TIMEOUT_AS_OF))


@register("mt10_majority", O.majority_details_sql(O.f3_cte(F3_NULL_EVERY), "f3", F3_MAJORITY))
def mt10_majority(spark, sf_dir):
    rec = M.reconcile(FX.f3_event_records(spark, sf_dir, F3_NULL_EVERY), F3_MAJORITY, FX.F1_AS_OF)
    return rec.details().select(M.REF, "system_name", "internal_id", "amount",
                                "discrepancy_found", "discrepancy_details")


@register("wn01_latest_per_source", f"""WITH {O.F1_CTE}, {O.latest_sql('f1')}
SELECT transaction_ref, source_system, internal_id, amount, CAST(n_records AS BIGINT) n_records,
       first_seen_src FROM latest""")
def wn01_latest_per_source(spark, sf_dir):
    return M.latest_per_source(FX.f1_records(spark, sf_dir)).select(
        M.REF, M.SRC, "internal_id", "amount", "n_records", "first_seen_src")


@register("ag03_ref_counts", f"""WITH {O.F1_CTE}
SELECT transaction_ref, CAST(count(*) AS BIGINT) record_count,
       CAST(count(DISTINCT source_system) AS INTEGER) source_count,
       min(server_received_at) first_seen_at,
       string_agg(DISTINCT source_system, ',' ORDER BY source_system) present_sources
FROM f1 GROUP BY transaction_ref""")
def ag03_ref_counts(spark, sf_dir):
    g = M.group_records(M.latest_per_source(FX.f1_records(spark, sf_dir)))
    return g.select(M.REF, "record_count", F.size("recs").alias("source_count"), "first_seen_at",
                    F.array_join(F.array_sort(F.transform("recs", lambda x: x["source_system"])), ",")
                    .alias("present_sources"))


# ── ingest pipeline (F2) ──────────────────────────────────────────────────
from ledgermesh.operators import idempotency as IDM  # noqa: E402


def _ingest(spark, sf_dir, *keep):
    """All columns, or keys, times, outcomes and ``keep`` only."""
    # checkpoint: the processed batch feeds both the per-key aggregate and the
    # join, so it is written once instead of parsing every payload twice
    return IDM.ingest_batch(FX.f2_envelopes(spark, sf_dir), FX.F2_AS_OF, checkpoint=True, keep=keep or None)


_ERRORS = ("source_system", "error_stage", "error_reason")


def tags_text(col="tags"):
    return F.array_join(F.array_sort(F.transform(F.map_entries(col),
                                                 lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


_PIPE = O.pipeline_sql(FX.F2_AS_OF)


@register("val_pipeline_outcome", f"""WITH {_PIPE}
SELECT row_id, transaction_ref, ok, error_stage, error_reason,
       CASE WHEN ok THEN amount END amount, CASE WHEN ok THEN currency END currency,
       CASE WHEN ok THEN record_timestamp END record_timestamp,
       CASE WHEN ok THEN payload_schema END payload_schema, CASE WHEN ok THEN tags_text END tags
FROM lab""")
def val_pipeline_outcome(spark, sf_dir):
    lab = _ingest(spark, sf_dir, M.REF, "error_stage", "error_reason", "amount", "currency", "record_timestamp",
                  "payload_schema", "tags").labelled
    return _outcomes(lab)


def _outcomes(lab):
    ok = F.col("ok")
    return lab.select("row_id", "transaction_ref", "ok", "error_stage", "error_reason",
                      F.when(ok, F.col("amount")).alias("amount"), F.when(ok, F.col("currency")).alias("currency"),
                      F.when(ok, F.col("record_timestamp")).alias("record_timestamp"),
                      F.when(ok, F.col("payload_schema")).alias("payload_schema"),
                      F.when(ok, tags_text()).alias("tags"))


@register("idm01_idempotency_labels", f"""WITH {_PIPE}
SELECT row_id, idempotency_key, idem_label, stored_internal_id FROM lab""")
def idm01_idempotency_labels(spark, sf_dir):
    return _ingest(spark, sf_dir, "row_id").labelled.select("row_id", "idempotency_key", "idem_label", "stored_internal_id")


@register("idm01_identical_resend", f"""WITH {_PIPE}
SELECT idempotency_key, idem_label, CAST(count(*) AS BIGINT) n FROM (
  SELECT idempotency_key, idem_label FROM lab
  UNION ALL
  SELECT idempotency_key, CASE idem_label WHEN 'stored' THEN 'duplicate' ELSE idem_label END FROM lab) GROUP BY ALL""")
def idm01_identical_resend(spark, sf_dir):
    """Every submission sent twice, equal in all columns and without a row id."""
    env = FX.f2_envelopes(spark, sf_dir).drop("row_id")
    lab = IDM.ingest_batch(env.unionByName(env), FX.F2_AS_OF).labelled
    return lab.groupBy("idempotency_key", "idem_label").agg(F.count(F.lit(1)).alias("n"))


@register("idm02_cross_batch", f"""WITH {_PIPE}
SELECT row_id, idempotency_key, idem_label, stored_internal_id FROM lab""")
def idm02_cross_batch(spark, sf_dir):
    """The copies arrive as batches of their own: labels as in one batch."""
    env = FX.f2_envelopes(spark, sf_dir)
    records = labelled = None
    for copy, _, _ in FX.F2_COPIES:
        res = IDM.ingest_batch(env.filter(F.col("row_id") % 10 == copy), FX.F2_AS_OF, checkpoint=True,
                               existing_keys=records)
        records = res.records if records is None else records.unionByName(res.records)
        labelled = res.labelled if labelled is None else labelled.unionByName(res.labelled)
    return labelled.select("row_id", "idempotency_key", "idem_label", "stored_internal_id")


@register("snk01_records", f"""WITH {_PIPE}
SELECT internal_id, idempotency_key, transaction_ref, source_system, adapter_type, amount, currency,
       server_received_at FROM lab WHERE idem_label = 'stored'""")
def snk01_records(spark, sf_dir):
    return _ingest(spark, sf_dir).records.select(
        "internal_id", "idempotency_key", "transaction_ref", "source_system", "adapter_type", "amount",
        "currency", "server_received_at")


@register("snk02_dlq", f"""WITH {_PIPE}
SELECT idempotency_key, transaction_ref, source_system, adapter_type, error_stage, error_reason,
       server_received_at created_at FROM lab WHERE idem_label = 'failed'""")
def snk02_dlq(spark, sf_dir):
    return _ingest(spark, sf_dir).dlq.select(
        "idempotency_key", "transaction_ref", "source_system", "adapter_type", "error_stage", "error_reason",
        "created_at")


@register("src09_ingest_summary", f"""WITH {_PIPE}
SELECT CAST(count(*) FILTER (WHERE idem_label <> 'failed') AS BIGINT) total_processed,
       CAST(count(*) FILTER (WHERE idem_label = 'failed') AS BIGINT) total_failed FROM lab""")
def src09_ingest_summary(spark, sf_dir):
    return _ingest(spark, sf_dir, "row_id").summary()


@register("mon03_validation_failures", f"""WITH {_PIPE}
SELECT source_system, error_stage, error_reason, CAST(count(*) AS BIGINT) failures
FROM lab WHERE idem_label = 'failed' GROUP BY ALL""")
def mon03_validation_failures(spark, sf_dir):
    failed = _ingest(spark, sf_dir, *_ERRORS).labelled.filter("idem_label = 'failed'")
    return (failed.groupBy("source_system", "error_stage", "error_reason")
            .agg(F.count(F.lit(1)).alias("failures")))


@register("ag05_dlq_depth", f"""WITH {_PIPE}
SELECT source_system, CAST(count(*) AS BIGINT) depth FROM lab WHERE idem_label = 'failed' GROUP BY ALL""")
def ag05_dlq_depth(spark, sf_dir):
    failed = _ingest(spark, sf_dir, "source_system").labelled.filter("idem_label = 'failed'")
    return failed.groupBy("source_system").agg(F.count(F.lit(1)).alias("depth"))


@register("mon04_duplicate_hits", f"""WITH {_PIPE}
SELECT source_system, CAST(count(*) FILTER (WHERE idem_label = 'duplicate') AS BIGINT) duplicate_hits,
       CAST(count(*) FILTER (WHERE idem_label = 'ignored_after_ttl') AS BIGINT) ignored_after_ttl
FROM lab GROUP BY ALL""")
def mon04_duplicate_hits(spark, sf_dir):
    return (_ingest(spark, sf_dir, "source_system").labelled.groupBy("source_system")
            .agg(F.count_if(F.col("idem_label") == "duplicate").alias("duplicate_hits"),
                 F.count_if(F.col("idem_label") == "ignored_after_ttl").alias("ignored_after_ttl")))


@register("idm04_conflicting_duplicates", f"""WITH {O.F2_CTE}
SELECT idempotency_key, CAST(count(DISTINCT sha256(coalesce(payload_text, ''))) AS BIGINT) distinct_payloads,
       CAST(count(*) AS BIGINT) submissions
FROM f2 WHERE coalesce(idempotency_key, '') <> '' GROUP BY 1 HAVING count(DISTINCT sha256(coalesce(payload_text, ''))) > 1""")
def idm04_conflicting_duplicates(spark, sf_dir):
    return IDM.conflicting_duplicates(FX.f2_envelopes(spark, sf_dir))


# ── state, due work, audit (F1 two-pass scenario) ─────────────────────────
from ledgermesh.operators import audit as AU  # noqa: E402
from ledgermesh.operators import state as ST  # noqa: E402
from ledgermesh.plans import scenarios as SC  # noqa: E402

_TWO = O.two_pass_sql(SC.RULES, SC.PASS1_AS_OF, SC.PASS2_AS_OF)
_STATE_COLS = ("transaction_ref, status, record_count, retry_count, max_retries, last_processed_at, "
               "resolved_at, created_at, matched_sources, mismatched_sources")


def state_cols(state):
    return state.select(M.REF, "status", "record_count", "retry_count", "max_retries", "last_processed_at",
                        "resolved_at", "created_at", F.array_join("matched_sources", ",").alias("matched_sources"),
                        F.array_join("mismatched_sources", ",").alias("mismatched_sources"))


@register("sta01_two_pass_state", f"{_TWO}\nSELECT {_STATE_COLS} FROM s2")
def sta01_two_pass_state(spark, sf_dir):
    _, p2 = SC.two_pass(spark, sf_dir)
    return state_cols(p2.tables.state)


@register("jn01_due_refs", f"{_TWO}\nSELECT transaction_ref FROM due2")
def jn01_due_refs(spark, sf_dir):
    p1 = SC.first_pass(spark, sf_dir)
    return ST.due_refs(FX.f1_records(spark, sf_dir), p1.tables.state, SC.PASS2_AS_OF, 30)


@register("lm01_due_batch_top100", f"{_TWO}\nSELECT transaction_ref FROM due2 ORDER BY transaction_ref LIMIT 100")
def lm01_due_batch_top100(spark, sf_dir):
    p1 = SC.first_pass(spark, sf_dir)
    return ST.due_refs(FX.f1_records(spark, sf_dir), p1.tables.state, SC.PASS2_AS_OF, 30, limit=100)


@register("str04_stale_decisions", f"""{_TWO},
cur AS (SELECT transaction_ref, CAST(count(*) AS BIGINT) current_record_count, max(server_received_at) latest_record_at
        FROM f1 GROUP BY 1)
SELECT s2.transaction_ref, s2.status, s2.record_count decided_record_count, cur.current_record_count
FROM s2 JOIN cur USING (transaction_ref)
WHERE s2.status IN ('MATCHED', 'MISMATCHED')
  AND (cur.current_record_count > s2.record_count OR cur.latest_record_at > s2.last_processed_at)""")
def str04_stale_decisions(spark, sf_dir):
    _, p2 = SC.two_pass(spark, sf_dir)
    return ST.stale_decisions(FX.f1_records(spark, sf_dir), p2.tables.state).select(
        M.REF, "status", "decided_record_count", "current_record_count")


@register("jn04_propagate_status", f"""{_TWO}
SELECT f1.internal_id, f1.transaction_ref, coalesce(CASE WHEN s2.status <> 'PENDING' THEN s2.status END, 'PENDING') status
FROM f1 LEFT JOIN s2 USING (transaction_ref)""")
def jn04_propagate_status(spark, sf_dir):
    _, p2 = SC.two_pass(spark, sf_dir)
    # pass-2 records carry pass-1 propagation; re-propagate from the final state
    return ST.propagate_status(FX.f1_records(spark, sf_dir), p2.tables.state).select(
        "internal_id", M.REF, "status")


@register("au01_audit_trail", f"""{_TWO},
ev AS (
  SELECT transaction_ref, 'pass1' batch_id, 'NEW' old_status, status new_status FROM s1
  UNION ALL
  SELECT d2.transaction_ref, 'pass2', coalesce(s1.status, 'NEW'), d2.status
  FROM d2 LEFT JOIN s1 USING (transaction_ref))
SELECT transaction_ref, CAST(row_number() OVER (PARTITION BY transaction_ref ORDER BY batch_id) AS INTEGER) ordinal,
       'MATCH_ATTEMPT' event_type, old_status, new_status FROM ev""")
def au01_audit_trail(spark, sf_dir):
    _, p2 = SC.two_pass(spark, sf_dir)
    return AU.audit_trail(p2.tables.audit).select(M.REF, "ordinal", "event_type", "old_status", "new_status")


@register("au02_replay_status", f"""{_TWO}
SELECT transaction_ref, status replayed_status, status state_status FROM s2""")
def au02_replay_status(spark, sf_dir):
    _, p2 = SC.two_pass(spark, sf_dir)
    rp = AU.replay_status(p2.tables.audit)
    return rp.join(p2.tables.state.select(M.REF, F.col("status").alias("state_status")), M.REF, "full_outer")


@register("mt16_retrigger", f"""WITH {O.F1_CTE},
{O.latest_sql('f1', '3')},
{O.decisions_sql(SC.RULES, SC.RETRIGGER_AS_OF, '3')},
{O.status_sql(SC.RULES, '3')}
SELECT transaction_ref, status, CAST(record_count AS BIGINT) record_count, 1 retry_count,
       CASE WHEN status = 'MISMATCHED' THEN coalesce(flagged_sorted, '') ELSE '' END mismatched_sources
FROM dec3""")
def mt16_retrigger(spark, sf_dir):
    out = SC.after_retrigger(spark, sf_dir)
    return out.tables.state.select(M.REF, "status", "record_count", "retry_count",
                     F.array_join("mismatched_sources", ",").alias("mismatched_sources"))


# ── resolution and retry queue (F4) ───────────────────────────────────────
from ledgermesh.config import AutoResolveConfig, RetryPolicy  # noqa: E402
from ledgermesh.operators import resolution as RS  # noqa: E402
from ledgermesh.operators import retry as RT  # noqa: E402
from ledgermesh.plans.batch import ReconTables  # noqa: E402

_F4 = f"WITH {O.F1_CTE},\n{O.f4_sql(SC.RULES, SC.F4_AS_OF)}"
_K = "CAST(substr(transaction_ref, 5) AS BIGINT)"
_NOW4 = O.ts_lit(SC.F4_AS_OF)


def _outcome(res: RS.ResolutionOutcome):
    return res.resolutions.select(M.REF, F.lit("resolved").alias("outcome"), "chosen_source",
                                  F.col("resolution_reason").alias("text")).unionByName(
        res.rejections.select(M.REF, F.lit("rejected").alias("outcome"),
                              F.lit(None).cast("string").alias("chosen_source"), F.col("reason").alias("text")))


def _auto(spark, sf_dir, strategy, prio=""):
    t = SC.f4_tables(spark, sf_dir)
    refs = t.state.select(M.REF)
    return _outcome(RS.auto_resolve(refs, t.state, t.records, t.details, SC.F4_AS_OF, strategy=strategy,
                                    cfg=AutoResolveConfig(source_priority=prio)))


def _auto_sql(win_cte: str, text: str) -> str:
    return f"""{_F4},
refs AS (SELECT transaction_ref, status FROM dec4),
{win_cte}
SELECT r.transaction_ref,
       CASE WHEN r.status IN ('MISMATCHED', 'RESOLVED') THEN 'resolved' ELSE 'rejected' END outcome,
       CASE WHEN r.status IN ('MISMATCHED', 'RESOLVED') THEN w.chosen END chosen_source,
       CASE WHEN r.status IN ('MISMATCHED', 'RESOLVED') THEN {text}
            ELSE 'cannot resolve transaction in status ' || r.status END text
FROM refs r LEFT JOIN win w USING (transaction_ref)"""


@register("rs03_auto_latest_record", _auto_sql(
    "win AS (SELECT transaction_ref, arg_max(source_system, (server_received_at, internal_id)) chosen FROM f1 GROUP BY 1)",
    """'latest_record: "' || w.chosen || '" submitted most recently'"""))
def rs03_auto_latest_record(spark, sf_dir):
    return _auto(spark, sf_dir, "latest")


@register("rs05_auto_first_submitted", _auto_sql(
    "win AS (SELECT transaction_ref, arg_min(source_system, (server_received_at, internal_id)) chosen FROM f1 GROUP BY 1)",
    """'first_submitted: "' || w.chosen || '" submitted earliest'"""))
def rs05_auto_first_submitted(spark, sf_dir):
    return _auto(spark, sf_dir, "first_submitted")


@register("rs04_auto_highest_amount", _auto_sql(
    "win AS (SELECT transaction_ref, arg_max(source_system, (amount, source_system)) chosen FROM flags4 "
    "WHERE gate <> 'missing_wait' AND gate <> 'single_wait' AND amount IS NOT NULL GROUP BY 1)",
    """'highest_amount: "' || w.chosen || '" reports the highest amount'"""))
def rs04_auto_highest_amount(spark, sf_dir):
    return _auto(spark, sf_dir, "highest")


@register("rs04_auto_lowest_amount", _auto_sql(
    "win AS (SELECT transaction_ref, arg_min(source_system, (amount, source_system)) chosen FROM flags4 "
    "WHERE gate <> 'missing_wait' AND gate <> 'single_wait' AND amount IS NOT NULL GROUP BY 1)",
    """'lowest_amount: "' || w.chosen || '" reports the lowest amount'"""))
def rs04_auto_lowest_amount(spark, sf_dir):
    return _auto(spark, sf_dir, "lowest_amount")


@register("rs02_auto_source_priority", _auto_sql(
    """win AS (SELECT transaction_ref, CASE WHEN bool_or(source_system = 'payment_gateway') THEN 'payment_gateway'
                 WHEN bool_or(source_system = 'erp_system') THEN 'erp_system' END chosen FROM f1 GROUP BY 1)""",
    """'source_priority: "' || w.chosen || '" is highest-priority source present (priority list: [payment_gateway, erp_system])'"""))
def rs02_auto_source_priority(spark, sf_dir):
    return _auto(spark, sf_dir, "source_priority", "payment_gateway, erp_system")


_DECISIONS = f"""
dcs AS (
  SELECT transaction_ref FROM dec4 WHERE status = 'MISMATCHED' AND {_K} % 3 = 0
  UNION ALL SELECT transaction_ref FROM dec4 WHERE status = 'PENDING' AND {_K} % 100 = 9
  UNION ALL SELECT 'UNKNOWN-' || transaction_ref FROM dec4 WHERE {_K} % 500 = 0),
man AS (
  SELECT d.transaction_ref, s.status FROM dcs d LEFT JOIN dec4 s USING (transaction_ref))"""


@register("rs07_manual_resolution", f"""{_F4},{_DECISIONS}
SELECT transaction_ref,
       CASE WHEN status IN ('MISMATCHED', 'RESOLVED') THEN 'resolved' ELSE 'rejected' END outcome,
       CASE WHEN status IN ('MISMATCHED', 'RESOLVED') THEN 'erp_system' END chosen_source,
       CASE WHEN status IN ('MISMATCHED', 'RESOLVED') THEN 'manual review'
            WHEN status IS NULL THEN 'not_found: transaction not found'
            ELSE 'invalid_status: cannot resolve transaction in status ' || status END text
FROM man""")
def rs07_manual_resolution(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    return _outcome(RS.resolve_manually(SC.f4_decisions(t.state), t.state, SC.F4_AS_OF))


@register("rs08_golden_records", f"""{_F4},{_DECISIONS}
SELECT m.transaction_ref, 'erp_system' chosen_source, l.internal_id, l.amount, l.currency,
       '{{"id":"' || l.internal_id || '"}}' payload_text
FROM man m JOIN latest4 l ON l.transaction_ref = m.transaction_ref AND l.source_system = 'erp_system'
WHERE m.status IN ('MISMATCHED', 'RESOLVED')""")
def rs08_golden_records(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    res = RS.resolve_manually(SC.f4_decisions(t.state), t.state, SC.F4_AS_OF)
    records = t.records.withColumn("payload_text", F.concat(F.lit('{"id":"'), "internal_id", F.lit('"}')))
    return RS.golden_records(res.resolutions, records).select(M.REF, "chosen_source", "internal_id", "amount",
                                                              "currency", "payload_text")


@register("sta02_mark_resolved", f"""{_F4},{_DECISIONS}
SELECT d.transaction_ref, CASE WHEN m.transaction_ref IS NOT NULL THEN 'RESOLVED' ELSE d.status END status
FROM dec4 d LEFT JOIN (SELECT transaction_ref FROM man WHERE status IN ('MISMATCHED', 'RESOLVED')) m
USING (transaction_ref)""")
def sta02_mark_resolved(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    res = RS.resolve_manually(SC.f4_decisions(t.state), t.state, SC.F4_AS_OF)
    return res.state.select(M.REF, "status")


@register("rt01_enqueue_retry", f"""{_F4},
qb AS (SELECT * FROM q4 WHERE status <> 'RESOLVED'),
enq AS (SELECT transaction_ref FROM dec4 WHERE status = 'MISMATCHED')
SELECT coalesce(q.transaction_ref, e.transaction_ref) transaction_ref,
  CAST(CASE WHEN e.transaction_ref IS NOT NULL AND q.transaction_ref IS NOT NULL AND q.status <> 'EXHAUSTED'
            THEN q.attempt_count WHEN e.transaction_ref IS NOT NULL THEN 0 ELSE q.attempt_count END AS INTEGER) attempt_count,
  CAST(CASE WHEN e.transaction_ref IS NOT NULL THEN 5 ELSE q.max_attempts END AS INTEGER) max_attempts,
  CASE WHEN e.transaction_ref IS NOT NULL THEN {_NOW4} ELSE q.next_retry_at END next_retry_at,
  CASE WHEN e.transaction_ref IS NOT NULL AND q.transaction_ref IS NOT NULL AND q.status <> 'EXHAUSTED' THEN q.status
       WHEN e.transaction_ref IS NOT NULL THEN 'PENDING' ELSE q.status END status,
  CASE WHEN e.transaction_ref IS NOT NULL THEN 'ops' ELSE 'api' END requested_by
FROM qb q FULL OUTER JOIN enq e ON q.transaction_ref = e.transaction_ref""")
def rt01_enqueue_retry(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    qb = SC.f4_queue(t.state).filter("status <> 'RESOLVED'")  # finished entries were removed
    refs = t.state.select(M.REF)
    out = RT.enqueue_retry(qb, refs, t.state, SC.F4_AS_OF, max_attempts=5, requested_by="ops")
    return out.queue.select(M.REF, "attempt_count", "max_attempts", "next_retry_at", "status", "requested_by")


@register("rt02_backoff", f"""{_F4}
SELECT transaction_ref, attempt_count,
       CAST(least(60 * pow(2, attempt_count + 1 - 1), 3600) AS BIGINT) backoff_secs FROM q4""")
def rt02_backoff(spark, sf_dir):
    from ledgermesh.functions.times import backoff_seconds
    q = SC.f4_queue(SC.f4_tables(spark, sf_dir).state)
    return q.select(M.REF, "attempt_count", backoff_seconds(F.col("attempt_count") + 1).alias("backoff_secs"))


@register("lm04_due_retries_top50", f"""{_F4}
SELECT transaction_ref, attempt_count, next_retry_at FROM q4
WHERE status = 'PENDING' AND next_retry_at <= {_NOW4} ORDER BY next_retry_at, transaction_ref LIMIT 50""")
def lm04_due_retries_top50(spark, sf_dir):
    q = SC.f4_queue(SC.f4_tables(spark, sf_dir).state)
    return RT.due_retries(q, SC.RETRY_AS_OF, limit=50).select(M.REF, "attempt_count", "next_retry_at")


@register("ag06_retry_queue_stats", f"""{_F4}
SELECT CAST(count(*) FILTER (WHERE status = 'PENDING') AS BIGINT) pending,
       CAST(count(*) FILTER (WHERE status = 'EXHAUSTED') AS BIGINT) exhausted,
       CAST(count(*) FILTER (WHERE status = 'RESOLVED') AS BIGINT) resolved FROM q4""")
def ag06_retry_queue_stats(spark, sf_dir):
    return RT.queue_stats(SC.f4_queue(SC.f4_tables(spark, sf_dir).state))


@register("lm03_retry_queue_page", f"""{_F4}
SELECT transaction_ref, next_retry_at, status FROM q4 WHERE status = 'PENDING'
ORDER BY next_retry_at, transaction_ref LIMIT 50""")
def lm03_retry_queue_page(spark, sf_dir):
    q = SC.f4_queue(SC.f4_tables(spark, sf_dir).state)
    return RT.queue_page(q, page_size=50, status="PENDING").select(M.REF, "next_retry_at", "status")


@register("rt03_run_retries", f"""WITH {O.F1_CTE}, {O.FIX_CTE},
{O.f4_sql(SC.RULES, SC.F4_AS_OF)},
due AS (SELECT * FROM q4 WHERE status = 'PENDING' AND next_retry_at <= {_NOW4}),
r5 AS (SELECT * FROM f1x WHERE transaction_ref IN (SELECT transaction_ref FROM due)),
{O.latest_sql('r5', '5')},
{O.decisions_sql(SC.RULES, SC.RETRY_AS_OF, '5')},
{O.status_sql(SC.RULES, '5')},
tr AS (
  SELECT q.*, q.attempt_count + 1 attempt, coalesce(d.status, 'ERROR') es FROM due q
  LEFT JOIN dec5 d USING (transaction_ref)),
tr2 AS (
  SELECT *, es IN ('MATCHED', 'RESOLVED') done, es = 'MISMATCHED' AND attempt >= max_attempts exhaust FROM tr)
SELECT transaction_ref, es engine_status,
  CASE WHEN done THEN 'RESOLVED' WHEN exhaust THEN 'EXHAUSTED' ELSE status END new_status,
  CAST(CASE WHEN done OR exhaust THEN attempt_count ELSE attempt END AS INTEGER) new_attempt_count,
  CASE WHEN done OR exhaust THEN next_retry_at
       ELSE {_NOW4} + to_seconds(CAST(least(60 * pow(2, attempt - 1), 3600) AS BIGINT)) END new_next_retry_at,
  CASE WHEN done THEN 'RETRY_RESOLVED' WHEN exhaust THEN 'RETRY_EXHAUSTED' WHEN es = 'ERROR' THEN 'RETRY_ENGINE_ERROR'
       WHEN es = 'MISMATCHED' THEN 'RETRY_ATTEMPT' END event
FROM tr2""")
def rt03_run_retries(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    recs = t.records.unionByName(SC.corrections(spark, sf_dir), allowMissingColumns=True)
    tx = ReconTables(recs, t.state, t.details, t.audit)
    out = RT.run_retries(tx, SC.f4_queue(t.state), SC.RULES, SC.RETRY_AS_OF, RetryPolicy())
    return out.transitions.select(M.REF, F.col("engine_status_final").alias("engine_status"), "new_status",
                                  "new_attempt_count", "new_next_retry_at", "event")


# ── listings, monitoring, matcher errors ──────────────────────────────────
from ledgermesh.operators import monitoring as MON  # noqa: E402
from ledgermesh.operators import views as V  # noqa: E402


@register("jn02_mismatches_with_source", f"""{_F4}
SELECT DISTINCT d.transaction_ref FROM dec4 d JOIN flags4 f USING (transaction_ref)
WHERE d.status = 'MISMATCHED' AND f.source_system = 'vendor_portal'""")
def jn02_mismatches_with_source(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    return V.mismatches_with_source(t.state, t.details, "vendor_portal").select(M.REF)


@register("lm02_mismatch_page", f"""{_F4}
SELECT transaction_ref FROM dec4 WHERE status = 'MISMATCHED' AND transaction_ref > 'ORD-5'
ORDER BY transaction_ref LIMIT 100""")
def lm02_mismatch_page(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    return V.list_mismatches(t.state, t.details, size=100, after="ORD-5").select(M.REF)


@register("jn03_attach_details", f"""{_F4}
SELECT d.transaction_ref, string_agg(f.source_system || ':' || CAST(f.flagged AS VARCHAR), ','
       ORDER BY f.source_system) details
FROM dec4 d JOIN flags4 f USING (transaction_ref) WHERE d.status = 'MISMATCHED' GROUP BY 1""")
def jn03_attach_details(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    out = V.attach_details(t.state.filter(F.col("status") == "MISMATCHED").select(M.REF), t.details)
    return out.select(M.REF, F.array_join(F.transform("details", lambda d: F.concat(
        d["system_name"], F.lit(":"), F.lower(d["discrepancy_found"].cast("string")))), ",").alias("details"))


@register("jn05_state_report", f"""{_F4}
SELECT d.transaction_ref, d.status, CAST(count(f.source_system) FILTER (WHERE d.status <> 'PENDING') AS BIGINT) n_details,
       epoch_ms({_NOW4}) last_updated_ms
FROM dec4 d JOIN flags4 f USING (transaction_ref)
GROUP BY d.transaction_ref, d.status""")
def jn05_state_report(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    return ST.state_report(t.state, t.details).select(
        M.REF, "status", F.size("details").cast("bigint").alias("n_details"), "last_updated_ms")


@register("jn06_missing_sources", f"""WITH {O.F1_CTE}, {O.latest_sql('f1')},
{O.decisions_sql(F1_EXPECTED, F1_TIMEOUT_AS_OF)}
SELECT transaction_ref, array_to_string(missing, ',') missing_sources FROM g""")
def jn06_missing_sources(spark, sf_dir):
    rec = M.reconcile(FX.f1_records(spark, sf_dir), F1_EXPECTED, F1_TIMEOUT_AS_OF)
    return rec.refs.select(M.REF, F.array_join("missing_sources", ",").alias("missing_sources"))


@register("lm05_latest_per_source_top5", f"""WITH {O.F1_CTE}
SELECT source_system, internal_id, server_received_at FROM (
  SELECT *, row_number() OVER (PARTITION BY source_system ORDER BY server_received_at DESC, internal_id DESC) rn
  FROM f1) WHERE rn <= 5""")
def lm05_latest_per_source_top5(spark, sf_dir):
    return V.latest_records_per_source(FX.f1_records(spark, sf_dir), 5).select(
        "source_system", "internal_id", "server_received_at")


@register("mon01_ingestion_rate", f"""WITH {_PIPE}
SELECT time_bucket(INTERVAL '1 minute', server_received_at) window_start, source_system,
       CASE idem_label WHEN 'stored' THEN 'success' WHEN 'failed' THEN 'failed' ELSE 'duplicate' END status,
       CAST(count(*) AS BIGINT) records, count(*) / 60.0 per_second
FROM lab GROUP BY ALL""")
def mon01_ingestion_rate(spark, sf_dir):
    return MON.ingestion_rate(_ingest(spark, sf_dir, "source_system").labelled).select(
        "window_start", "source_system", "status", "records", "per_second")


@register("mon02_error_rate", f"""WITH {_PIPE}
SELECT time_bucket(INTERVAL '1 minute', server_received_at) window_start, CAST(count(*) AS BIGINT) total,
       CAST(count(*) FILTER (WHERE idem_label = 'failed') AS BIGINT) failed
FROM lab GROUP BY ALL""")
def mon02_error_rate(spark, sf_dir):
    return MON.error_rate(_ingest(spark, sf_dir, "row_id").labelled)


_BOUNDS = MON.PAYLOAD_BUCKETS


@register("mon05_payload_size_histogram", f"""WITH {O.F2_CTE},
b AS (SELECT unnest([{", ".join(f"'{b}'" for b in _BOUNDS)}, '+Inf']) le,
             unnest([{", ".join(str(b) for b in _BOUNDS)}, 9223372036854775807]) bound)
SELECT f2.source_system, b.le, CAST(count(*) FILTER (WHERE octet_length(encode(payload_text)) <= b.bound) AS BIGINT)
       cumulative_count
FROM f2, b GROUP BY ALL""")
def mon05_payload_size_histogram(spark, sf_dir):
    env = FX.f2_envelopes(spark, sf_dir).withColumn("payload_bytes", F.octet_length("payload_text"))
    return MON.payload_size_histogram(env)


@register("mon06_outcomes_by_status", f"""{_F4}
SELECT status, CAST(count(*) AS BIGINT) refs FROM dec4 GROUP BY 1""")
def mon06_outcomes_by_status(spark, sf_dir):
    return MON.outcomes_by_status(SC.f4_tables(spark, sf_dir).state)


@register("mon07_decision_latency", f"""{_F4},
lat AS (SELECT s.status, CAST(epoch({_NOW4}) - epoch(d.first_seen_at) AS BIGINT) latency_s
        FROM g4 d JOIN dec4 s USING (transaction_ref))
SELECT status, quantile_disc(latency_s, 0.5) p50_s, quantile_disc(latency_s, 0.95) p95_s,
       CAST(count(*) AS BIGINT) refs FROM lat GROUP BY 1""")
def mon07_decision_latency(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    return MON.decision_latency(t.state, t.records)


@register("mon08_batch_size_histogram", f"""{_TWO},
sizes AS (SELECT 'pass1' b, count(*) n FROM s1 UNION ALL SELECT 'pass2', count(*) FROM d2),
bk AS (SELECT unnest([{", ".join(f"'{b}'" for b in MON.BATCH_BUCKETS)}, '+Inf']) le,
              unnest([{", ".join(str(b) for b in MON.BATCH_BUCKETS)}, 9223372036854775807]) bound)
SELECT bk.le, CAST(count(*) FILTER (WHERE sizes.n <= bk.bound) AS BIGINT) cumulative_count FROM bk, sizes GROUP BY 1""")
def mon08_batch_size_histogram(spark, sf_dir):
    _, p2 = SC.two_pass(spark, sf_dir)
    return MON.batch_size_histogram(p2.tables.audit)


@register("mon09_resolutions_by_resolver", f"""{_F4},{_DECISIONS}
SELECT 'MANUAL' resolution_type, 'tester' resolver_id, CAST(count(*) AS BIGINT) resolutions
FROM man WHERE status IN ('MISMATCHED', 'RESOLVED')""")
def mon09_resolutions_by_resolver(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    res = RS.resolve_manually(SC.f4_decisions(t.state), t.state, SC.F4_AS_OF)
    return MON.resolutions_by_resolver(res.resolutions)


@register("mon11_retrigger_count", f"""WITH {O.F1_CTE}
SELECT CAST(count(DISTINCT transaction_ref) AS BIGINT) retriggers FROM f1""")
def mon11_retrigger_count(spark, sf_dir):
    return MON.retrigger_count(SC.after_retrigger(spark, sf_dir).tables.audit)


_AMOUNT_RE = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"


@register("mt05_amount_errors", f"""WITH {O.F1_CTE}, {O.F2_CTE},
fa AS (
  SELECT transaction_ref, 'f2-' || CAST(row_id AS VARCHAR) internal_id, server_received_at,
         nullif(CASE WHEN json_valid(payload_text) AND json_type(payload_text) = 'OBJECT'
                     THEN json_extract_string(payload_text, '$.amount') END, '') amount_text
  FROM f2),
lf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_ref
                      ORDER BY server_received_at DESC, internal_id DESC) rn FROM fa) WHERE rn = 1)
SELECT transaction_ref, 'f2_feed' error_source, amount_text error_value FROM lf
WHERE transaction_ref IN (SELECT transaction_ref FROM f1) AND amount_text IS NOT NULL
  AND (NOT regexp_full_match(amount_text, '{_AMOUNT_RE}') OR try_cast(amount_text AS DECIMAL(22,6)) IS NULL
       OR CAST(try_cast(amount_text AS DECIMAL(22,6)) AS DECIMAL(38,12)) <> try_cast(amount_text AS DECIMAL(38,12)))""")
def mt05_amount_errors(spark, sf_dir):
    f1 = FX.f1_records(spark, sf_dir).withColumn("amount", F.col("amount").cast("string"))
    env = FX.f2_envelopes(spark, sf_dir)
    v = F.try_parse_json("payload_text")
    feed = env.select("transaction_ref", F.lit("f2_feed").alias("source_system"),
                      F.concat(F.lit("f2-"), F.col("row_id").cast("string")).alias("internal_id"),
                      F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)),
                             F.try_variant_get(v, "$.amount", "string")).alias("amount"),
                      F.lit("USD").alias("currency"), "server_received_at")
    rec = M.reconcile(f1.unionByName(feed), F1_RULES, FX.F1_AS_OF)
    return rec.errors().select(M.REF, "error_source", "error_value")


# ── sources over the given tables ─────────────────────────────────────────
from ledgermesh.sources import database as DB  # noqa: E402

_SINCE = dt.datetime(1998, 1, 1)


def _orders_as_db_table(spark, sf_dir):
    o = FX.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"),
                    F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))


@register("src07_incremental_rows", f"""
SELECT o_orderkey order_id, o_orderdate updated_at FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'""")
def src07_incremental_rows(spark, sf_dir):
    rows, _ = DB.read_incremental(_orders_as_db_table(spark, sf_dir), "updated_at", since=_SINCE)
    return rows.select("order_id", "updated_at")


@register("src07_new_watermark", """
SELECT coalesce(max(o_orderdate), TIMESTAMP '1998-01-01 00:00:00') watermark FROM orders
WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'""")
def src07_new_watermark(spark, sf_dir):
    _, wm = DB.read_incremental(_orders_as_db_table(spark, sf_dir), "updated_at", since=_SINCE)
    return wm


@register("src08_db_rows_to_envelopes", """
SELECT CAST(o_orderkey AS VARCHAR) transaction_ref, 'db_poll' adapter_type, 'db_row.v1' payload_schema,
       'erp_db' source_system, CAST(o_orderkey AS VARCHAR) payload_ref, o_orderstatus payload_status,
       CASE WHEN o_orderkey % 3 = 0 THEN 'id-' || o_orderkey END own_key,
       CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) n,
       CAST(CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 THEN 2 ELSE 1 END AS BIGINT) keys FROM orders""")
def src08_db_rows_to_envelopes(spark, sf_dir):
    """A third of the rows bring an id, a fifth come twice: equal rows without an id
    have keys of their own."""
    rows = _orders_as_db_table(spark, sf_dir).withColumn("id", F.when(
        F.col("order_id") % 3 == 0, F.concat(F.lit("id-"), F.col("order_id").cast("string"))))
    twice = rows.withColumn("_n", F.explode(F.when(F.col("order_id") % 5 == 0, F.array(F.lit(1), F.lit(2)))
                                            .otherwise(F.array(F.lit(1))))).drop("_n")
    env = DB.pick_key(twice, "erp_db")
    own = F.when(F.col("idempotency_key").startswith("id-"), F.col("idempotency_key"))
    field = lambda name: F.get_json_object("payload_text", f"$.{name}")
    return env.groupBy("transaction_ref", "adapter_type", "payload_schema", "source_system",
                       field("order_id").alias("payload_ref"), field("status").alias("payload_status"),
                       own.alias("own_key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("idempotency_key").alias("keys"))


from ledgermesh.sources import (csv_lines_to_envelopes, explode_bodies, from_kafka,  # noqa: E402
                                ndjson_lines_to_envelopes)

# The submissions of F2 as the adapters see them (payloads that are no object stay as they are).
_LANDED = f"""{_PIPE},
landed AS (SELECT *, CASE WHEN payload_text LIKE '{{%' THEN '{{"idempotency_key":"' || idempotency_key || '","transaction_ref":"'
       || replace(transaction_ref, chr(7), '') || '",' || substr(payload_text, 2) ELSE payload_text END line FROM f2)"""


def _landed(spark, sf_dir):
    env = FX.f2_envelopes(spark, sf_dir)
    head = F.concat(F.lit('{"idempotency_key":"'), "idempotency_key", F.lit('","transaction_ref":"'),
                    F.translate("transaction_ref", "\u0007", ""), F.lit('",'))
    return env.withColumn("line", F.when(F.col("payload_text").startswith("{"), F.concat(
        head, F.substr("payload_text", F.lit(2)))).otherwise(F.col("payload_text")))


# Keyless records get keys of their own, which the statements count and do not rebuild.
_KEYED = "CASE WHEN line LIKE '{%' THEN nullif(idempotency_key, '') END"
_REF = "CASE WHEN line LIKE '{%' THEN replace(transaction_ref, chr(7), '') ELSE '' END"


def _mapped(env, payload=True):
    own = F.col("idempotency_key").startswith("key-")
    cols = [M.REF, "source_system", "adapter_type"] + (["payload_text"] if payload else [])
    return env.groupBy(*cols, F.when(own, F.col("idempotency_key")).alias("own_key")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("idempotency_key").alias("keys"))


@register("src01_ndjson_lines", f"""WITH {_LANDED}
SELECT transaction_ref, 'feed' source_system, 'file' adapter_type, payload_text, own_key,
       CAST(count(*) AS BIGINT) n, CAST(if(own_key IS NULL, count(*), 1) AS BIGINT) keys
FROM (SELECT {_REF} transaction_ref, line payload_text, {_KEYED} own_key FROM landed)
GROUP BY transaction_ref, payload_text, own_key""")
def src01_ndjson_lines(spark, sf_dir):
    return _mapped(ndjson_lines_to_envelopes(_landed(spark, sf_dir), "feed", text_col="line"))


@register("src02_csv_lines", """
SELECT 'ORD-' || o_orderkey transaction_ref, 'feed' source_system, 'file' adapter_type, 'key-' || o_orderkey own_key,
       'csv.v1' payload_schema, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) amount,
       CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'a "b", c' END note FROM orders""")
def src02_csv_lines(spark, sf_dir):
    """Two files whose headers differ in order, case and width."""
    k = F.col("o_orderkey").cast("string")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    even = F.col("o_orderkey") % 2 == 0
    key, ref = F.concat(F.lit("key-"), k), F.concat(F.lit("ORD-"), k)
    lines = FX.table(spark, sf_dir, "orders").select(
        F.when(even, F.lit("a.csv")).otherwise(F.lit("b.csv")).alias("_path"),
        F.when(even, F.lit("Idempotency_Key, Amount ,transaction_ref"))
        .otherwise(F.lit("amount,transaction_ref,idempotency_key,Note")).alias("_header"),
        F.when(even, F.concat_ws(",", key, price, ref))
        .otherwise(F.concat_ws(",", price, ref, key, F.lit('"a ""b"", c"'))).alias("value"))
    env = csv_lines_to_envelopes(lines, "feed", 4)
    return env.select(M.REF, "source_system", "adapter_type", F.col("idempotency_key").alias("own_key"), "payload_schema",
                      F.get_json_object("payload_text", "$.amount").alias("amount"),
                      F.get_json_object("payload_text", "$.note").alias("note"))


def _order_files(spark, sf_dir, kind):
    """The orders as 16 CSV (or NDJSON) files in the checkpoint folder: their path."""
    import uuid
    from ledgermesh.session import ensure_checkpoint_dir
    k = F.col("o_orderkey").cast("string")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    o = FX.table(spark, sf_dir, "orders").withColumn("file", (F.col("o_orderkey") % 16).cast("int"))
    key, ref, even = F.concat(F.lit("key-"), k), F.concat(F.lit("ORD-"), k), F.col("file") % 2 == 0
    if kind == "csv":  # headers differ by file; every seventh note spans lines, every eleventh row is a header again
        heads = F.when(even, F.lit("Idempotency_Key, Amount ,transaction_ref,note")).otherwise(
            F.lit("amount,transaction_ref,idempotency_key,Note,more"))
        note = F.when(F.col("o_orderkey") % 7 == 0, F.lit('"two\nlines, ""quoted"""')).otherwise(F.lit("plain"))
        value = F.when(even, F.concat_ws(",", key, price, ref, note)).otherwise(F.concat_ws(",", price, ref, key, note))
        value = F.when(F.col("o_orderkey") % 11 == 0, F.concat(value, F.lit("\n"), heads)).otherwise(value)
        first = o.select("file").distinct().select("file", F.lit(-1).cast("long").alias("at"), heads.alias("value"))
        rows = first.unionByName(o.select("file", F.col("o_orderkey").alias("at"), value.alias("value")))
    else:
        line = F.concat(F.lit('{"idempotency_key":"'), key, F.lit('","transaction_ref":"'), ref, F.lit('"}'))
        rows = o.select("file", F.col("o_orderkey").alias("at"), line.alias("value"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    rows.repartition("file").sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").text(path)
    return path


@register("src02_csv_files", """
SELECT 'ORD-' || o_orderkey transaction_ref, 'key-' || o_orderkey idempotency_key,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) amount,
       CASE WHEN o_orderkey % 7 = 0 THEN 'two' || chr(10) || 'lines, "quoted"' ELSE 'plain' END note,
       CAST(1 AS BIGINT) n FROM orders
UNION ALL
SELECT 'transaction_ref', CASE WHEN o_orderkey % 2 = 0 THEN 'Idempotency_Key' ELSE 'idempotency_key' END,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Amount ' ELSE 'amount' END, CASE WHEN o_orderkey % 2 = 0 THEN 'note' ELSE 'Note' END,
       CAST(count(*) AS BIGINT) FROM orders WHERE o_orderkey % 11 = 0 GROUP BY ALL""")
def src02_csv_files(spark, sf_dir):
    """Files with their own headers, quoted line ends and data rows that equal the header."""
    from ledgermesh.sources import read_csv
    env = read_csv(spark, _order_files(spark, sf_dir, "csv"), "feed")
    field = lambda name: F.get_json_object("payload_text", f"$.{name}")
    return env.groupBy(M.REF, "idempotency_key", field("amount").alias("amount"), field("note").alias("note")).agg(
        F.count(F.lit(1)).alias("n"))


@register("src03_route_files", """
SELECT 'ORD-' || o_orderkey transaction_ref, 'key-' || o_orderkey idempotency_key, 'file' adapter_type, 'erp' source_system,
       payload_schema FROM orders, (VALUES ('csv.v1'), (NULL)) t(payload_schema)""")
def src03_route_files(spark, sf_dir):
    """One folder with the orders as CSV and as NDJSON files, and a file of another
    kind that is not read."""
    import uuid
    from ledgermesh.session import ensure_checkpoint_dir
    from ledgermesh.sources import route_files
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/route-{uuid.uuid4().hex}"
    k = F.col("o_orderkey").cast("string")
    o = FX.table(spark, sf_dir, "orders")
    csv = [F.concat(F.lit("key-"), k).alias("idempotency_key"), F.concat(F.lit("ORD-"), k).alias("transaction_ref")]
    line = F.concat(F.lit('{"idempotency_key":"key-'), k, F.lit('","transaction_ref":"ORD-'), k, F.lit('"}'))
    o.select(*csv).write.option("header", "true").csv(f"{folder}/a.csv")
    o.select(line.alias("value")).write.text(f"{folder}/b.ndjson")
    o.select(line.alias("value")).write.text(f"{folder}/c.log")
    return route_files(spark, folder, "erp").select(M.REF, "idempotency_key", "adapter_type", "source_system", "payload_schema")


@register("src04_webhook_bodies", f"""WITH {_LANDED}
SELECT transaction_ref, 'feed' source_system, 'webhook' adapter_type, own_key,
       CAST(count(*) AS BIGINT) n, CAST(if(own_key IS NULL, count(*), 1) AS BIGINT) keys
FROM (SELECT {_REF} transaction_ref, {_KEYED} own_key FROM landed) GROUP BY transaction_ref, own_key""")
def src04_webhook_bodies(spark, sf_dir):
    """One request per submission: an object over several lines, an array of
    one, or a line, by the copy it is."""
    line, obj = F.col("line"), F.col("line").startswith("{")
    copy = F.col("row_id") % 10
    bodies = _landed(spark, sf_dir).select(
        F.lit("feed").alias("source_system"), F.col("row_id").cast("string").alias("request_id"),
        F.when(obj & (copy == 0), F.regexp_replace(line, '^\\{', '{\n  '))
        .when(obj & (copy == 1), F.concat(F.lit("["), line, F.lit("]"))).otherwise(line).alias("body"))
    return _mapped(explode_bodies(bodies), payload=False)


@register("src06_kafka_messages", f"""WITH {_LANDED}
SELECT {_REF} transaction_ref, 'feed' source_system, 'kafka' adapter_type,
       coalesce({_KEYED}, 'kafka-submissions-0-' || row_id) idempotency_key, line payload_text FROM landed""")
def src06_kafka_messages(spark, sf_dir):
    rows = _landed(spark, sf_dir).select(
        F.lit(None).cast("binary").alias("key"), F.col("line").cast("binary").alias("value"),
        F.lit("submissions").alias("topic"), F.lit(0).alias("partition"), F.col("row_id").cast("bigint").alias("offset"),
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"))
    env, _ = from_kafka(rows, "feed")
    text = "payload_text" if "payload_text" in env.columns else "payload"
    return env.select(M.REF, "source_system", "adapter_type", "idempotency_key",
                      F.col(text).cast("string").alias("payload_text"))


# ── remaining sinks and counters ──────────────────────────────────────────
@register("snk01_write_records_dedup", f"""WITH {_PIPE},
base AS (SELECT * FROM lab WHERE idem_label = 'stored' AND adapter_type = 'file'),
new AS (SELECT * FROM lab WHERE idem_label IN ('stored', 'ignored_after_ttl'))
SELECT internal_id, idempotency_key FROM base
UNION ALL
SELECT internal_id, idempotency_key FROM new WHERE idempotency_key NOT IN (SELECT idempotency_key FROM base)
QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY server_received_at, internal_id) = 1""")
def snk01_write_records_dedup(spark, sf_dir):
    lab = _ingest(spark, sf_dir, "adapter_type").labelled
    base = lab.filter((F.col("idem_label") == "stored") & (F.col("adapter_type") == "file")).select("internal_id", "idempotency_key")
    # filter on the label (computed after the key join), not on ``ok``: a
    # filter on ``ok`` would be pushed into the pipeline projections
    new = lab.filter(F.col("idem_label").isin("stored", "ignored_after_ttl")).select(
        "internal_id", "idempotency_key", "server_received_at")
    return IDM.write_records(base, new).select("internal_id", "idempotency_key")


@register("lm06_dlq_replay_batch", f"""WITH {_PIPE}
SELECT idempotency_key, error_reason FROM lab WHERE idem_label = 'failed'
ORDER BY server_received_at, idempotency_key LIMIT 100""")
def lm06_dlq_replay_batch(spark, sf_dir):
    return V.dlq_replay_batch(_ingest(spark, sf_dir).dlq, 3, limit=100).select("idempotency_key", "error_reason")


_REPLAY_AS_OF = dt.datetime(2999, 1, 2)


@register("rt05_dlq_replay", f"""WITH {_PIPE}
SELECT 'remaining' outcome, error_reason, CAST(count(*) AS BIGINT) n, CAST(1 AS INTEGER) retry_count FROM lab
WHERE idem_label = 'failed' AND error_reason <> 'future_timestamp' GROUP BY ALL
UNION ALL
SELECT 'recovered', 'future_timestamp', CAST(count(DISTINCT idempotency_key) AS BIGINT), 0 FROM lab
WHERE idem_label = 'failed' AND error_reason = 'future_timestamp'
HAVING count(*) > 0""")
def rt05_dlq_replay(spark, sf_dir):
    """By the time of the replay the records from the future are no longer ahead:
    one of each key recovers, its copies are duplicates."""
    recovered, remaining = IDM.dlq_replay(_ingest(spark, sf_dir).dlq, _REPLAY_AS_OF)
    kept = remaining.groupBy(F.lit("remaining").alias("outcome"), "error_reason").agg(
        F.count(F.lit(1)).alias("n"), F.max("retry_count").alias("retry_count"))
    return kept.unionByName(recovered.groupBy(F.lit("recovered").alias("outcome"), F.lit("future_timestamp").alias("error_reason"))
                            .agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("retry_count")))


@register("idm03_purge_expired", f"""WITH {_PIPE}
SELECT idempotency_key FROM lab WHERE idem_label = 'stored'
  AND server_received_at + INTERVAL 86400 SECOND > TIMESTAMP '1998-01-01 00:00:00'""")
def idm03_purge_expired(spark, sf_dir):
    idem = IDM.idempotency_table(_ingest(spark, sf_dir, "source_system").labelled)
    return IDM.purge_expired(idem, dt.datetime(1998, 1, 1)).select("idempotency_key")


@register("ag04_present_sources", f"""WITH {O.F1_CTE}
SELECT transaction_ref, string_agg(DISTINCT source_system, ',' ORDER BY source_system) present_sources
FROM f1 GROUP BY 1""")
def ag04_present_sources(spark, sf_dir):
    return RS.present_sources(FX.f1_records(spark, sf_dir)).select(
        M.REF, F.array_join("present_sources", ",").alias("present_sources"))


@register("mon10_retry_attempts_by_outcome", f"""WITH {O.F1_CTE}, {O.FIX_CTE},
{O.f4_sql(SC.RULES, SC.F4_AS_OF)},
due AS (SELECT * FROM q4 WHERE status = 'PENDING' AND next_retry_at <= {_NOW4}),
r5 AS (SELECT * FROM f1x WHERE transaction_ref IN (SELECT transaction_ref FROM due)),
{O.latest_sql('r5', '5')},
{O.decisions_sql(SC.RULES, SC.RETRY_AS_OF, '5')},
{O.status_sql(SC.RULES, '5')}
SELECT CASE WHEN d.status IN ('MATCHED', 'RESOLVED') THEN 'matched'
            WHEN d.status = 'MISMATCHED' AND q.attempt_count + 1 >= q.max_attempts THEN 'exhausted'
            WHEN d.status IS NULL THEN 'error' ELSE 'still_mismatched' END outcome,
       CAST(count(*) AS BIGINT) attempts
FROM due q LEFT JOIN dec5 d USING (transaction_ref) GROUP BY 1""")
def mon10_retry_attempts_by_outcome(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    recs = t.records.unionByName(SC.corrections(spark, sf_dir), allowMissingColumns=True)
    out = RT.run_retries(ReconTables(recs, t.state, t.details, t.audit), SC.f4_queue(t.state), SC.RULES,
                         SC.RETRY_AS_OF, RetryPolicy())
    return MON.retry_attempts_by_outcome(out.transitions)


@register("mon11_errors_by_ref", f"""WITH {O.F1_CTE}, {O.F2_CTE},
fa AS (
  SELECT transaction_ref, 'f2-' || CAST(row_id AS VARCHAR) internal_id, server_received_at,
         nullif(CASE WHEN json_valid(payload_text) AND json_type(payload_text) = 'OBJECT'
                     THEN json_extract_string(payload_text, '$.amount') END, '') amount_text
  FROM f2),
lf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_ref
                      ORDER BY server_received_at DESC, internal_id DESC) rn FROM fa) WHERE rn = 1)
SELECT transaction_ref, CAST(1 AS BIGINT) errors FROM lf
WHERE transaction_ref IN (SELECT transaction_ref FROM f1) AND amount_text IS NOT NULL
  AND (NOT regexp_full_match(amount_text, '{_AMOUNT_RE}') OR try_cast(amount_text AS DECIMAL(22,6)) IS NULL
       OR CAST(try_cast(amount_text AS DECIMAL(22,6)) AS DECIMAL(38,12)) <> try_cast(amount_text AS DECIMAL(38,12)))""")
def mon11_errors_by_ref(spark, sf_dir):
    errs = mt05_amount_errors(spark, sf_dir)
    return MON.errors_by_ref(errs)


@register("snk06_upsert_resolutions", f"""{_F4},{_DECISIONS},
win AS (SELECT transaction_ref, arg_max(source_system, (server_received_at, internal_id)) chosen FROM f1 GROUP BY 1),
auto AS (SELECT transaction_ref FROM dec4 WHERE status = 'MISMATCHED'),
manual AS (SELECT transaction_ref FROM man WHERE status IN ('MISMATCHED', 'RESOLVED'))
SELECT transaction_ref, 'MANUAL' resolution_type, 'erp_system' chosen_source FROM manual
UNION ALL
SELECT a.transaction_ref, 'AUTO', w.chosen FROM auto a JOIN win w USING (transaction_ref)
WHERE a.transaction_ref NOT IN (SELECT transaction_ref FROM manual)""")
def snk06_upsert_resolutions(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    refs = t.state.select(M.REF)
    auto = RS.auto_resolve(refs, t.state, t.records, t.details, SC.F4_AS_OF, strategy="latest_record")
    manual = RS.resolve_manually(SC.f4_decisions(t.state), t.state, SC.F4_AS_OF)
    merged = RS.upsert_resolutions(auto.resolutions, manual.resolutions)
    return merged.select(M.REF, "resolution_type", "chosen_source")


@register("rs06_queue_after_auto_resolve", f"""{_F4},
auto AS (SELECT transaction_ref FROM dec4 WHERE status = 'MISMATCHED')
SELECT transaction_ref, CASE WHEN transaction_ref IN (SELECT transaction_ref FROM auto) THEN 'RESOLVED' ELSE status END status,
       attempt_count FROM q4""")
def rs06_queue_after_auto_resolve(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    refs = t.state.select(M.REF)
    out = RS.auto_resolve(refs, t.state, t.records, t.details, SC.F4_AS_OF, strategy="latest_record",
                          queue=SC.f4_queue(t.state))
    return out.queue.select(M.REF, "status", "attempt_count")


# ── operators without a query of their own so far ─────────────────────────
from ledgermesh.config import IngestConfig  # noqa: E402
from ledgermesh.operators import due as DUE  # noqa: E402


_PIPE_V = O.pipeline_sql(FX.F2_AS_OF, src="f2v")
_SMALL_PAYLOAD = 115


@register("nrm_payload_variants", f"""WITH {_PIPE_V}
SELECT row_id, transaction_ref, ok, error_stage, error_reason,
       CASE WHEN ok THEN amount END amount, CASE WHEN ok THEN currency END currency,
       CASE WHEN ok THEN record_timestamp END record_timestamp,
       CASE WHEN ok THEN payload_schema END payload_schema, CASE WHEN ok THEN tags_text END tags
FROM lab""")
def nrm_payload_variants(spark, sf_dir):
    """NRM-1 (no payload), NRM-7 (extra fields that clash with tags) and NRM-8 (the
    ref in the payload only)."""
    return _outcomes(IDM.ingest_batch(FX.f2_variants(spark, sf_dir), FX.F2_AS_OF, checkpoint=True).labelled)


@register("val05_payload_too_large", f"""WITH {O.pipeline_sql(FX.F2_AS_OF, max_payload=_SMALL_PAYLOAD)}
SELECT error_stage, error_reason, CAST(count(*) AS BIGINT) n FROM lab GROUP BY ALL""")
def val05_payload_too_large(spark, sf_dir):
    cfg = IngestConfig(max_payload_bytes=_SMALL_PAYLOAD)
    lab = IDM.ingest_batch(FX.f2_envelopes(spark, sf_dir), FX.F2_AS_OF, cfg, checkpoint=True, keep=_ERRORS).labelled
    return lab.groupBy("error_stage", "error_reason").agg(F.count(F.lit(1)).alias("n"))


_NO_AMOUNT = """, f1n AS (SELECT * REPLACE (CASE WHEN CAST(substr(transaction_ref, 5) AS BIGINT) % 3 = 0 THEN NULL
  ELSE amount END AS amount) FROM f1)"""


@register("mt08_no_amounts", O.state_report_sql(O.F1_CTE + _NO_AMOUNT, "f1n", F1_EXACT, FX.F1_AS_OF))
def mt08_no_amounts(spark, sf_dir):
    recs = FX.f1_records(spark, sf_dir)
    return state_report(M.reconcile(recs.withColumn("amount", F.when(SC.order_key() % 3 != 0, F.col("amount"))),
                                    F1_EXACT, FX.F1_AS_OF))


@register("mt13_audit_payloads", f"""WITH {O.F1_CTE},
{O.latest_sql('f1')},
{O.decisions_sql(F1_RULES, FX.F1_AS_OF)},
{O.status_sql(F1_RULES)}
SELECT d.transaction_ref, d.status, CASE WHEN d.status <> 'MATCHED' THEN d.reason END reason,
  CASE WHEN d.status = 'MATCHED' THEN d.first_currency END currency,
  CASE WHEN d.status = 'MATCHED' THEN CAST(d.ref_amount AS VARCHAR) END reference_amount,
  CASE WHEN d.status = 'PENDING' THEN CAST(d.source_count AS VARCHAR) END record_count,
  CASE WHEN d.status <> 'PENDING' THEN string_agg(f.source_system || '=' || CAST(f.amount AS VARCHAR)
    || CASE WHEN d.status = 'MATCHED' THEN '' ELSE ':' || CAST(f.flagged AS VARCHAR) END, ',' ORDER BY f.pos) END sources
FROM dec d JOIN flags f USING (transaction_ref)
GROUP BY d.transaction_ref, d.status, d.reason, d.first_currency, d.ref_amount, d.source_count""")
def mt13_audit_payloads(spark, sf_dir):
    rec = M.reconcile(FX.f1_records(spark, sf_dir), F1_RULES, FX.F1_AS_OF)
    field = lambda name: F.get_json_object("details", f"$.{name}")
    sources = F.from_json(field("sources"), "array<struct<amount:string,system:string,discrepancy:boolean>>")
    text = F.transform(sources, lambda r: F.concat(r["system"], F.lit("="), r["amount"], F.coalesce(
        F.concat(F.lit(":"), r["discrepancy"].cast("string")), F.lit(""))))
    return rec.audit_details().select(
        M.REF, field("outcome").alias("status"), field("reason").alias("reason"), field("currency").alias("currency"),
        field("reference_amount").alias("reference_amount"), field("record_count").alias("record_count"),
        F.array_join(text, ",").alias("sources"))


@register("snk04_upsert_details", f"""{_TWO}
SELECT f.transaction_ref, f.source_system system_name, f.internal_id, f.amount, f.flagged discrepancy_found
FROM flags1 f JOIN dec1 d USING (transaction_ref) LEFT JOIN dec2 n USING (transaction_ref)
WHERE d.status <> 'PENDING' AND n.transaction_ref IS NULL
UNION ALL
SELECT f.transaction_ref, f.source_system, f.internal_id, f.amount, f.flagged
FROM flags2 f JOIN dec2 d USING (transaction_ref) WHERE d.status <> 'PENDING'""")
def snk04_upsert_details(spark, sf_dir):
    _, p2 = SC.two_pass(spark, sf_dir)
    return p2.tables.details.select(M.REF, "system_name", "internal_id", "amount", "discrepancy_found")


_RUN = f"""WITH {O.F1_CTE}, {O.FIX_CTE},
{O.f4_sql(SC.RULES, SC.F4_AS_OF)},
due AS (SELECT * FROM q4 WHERE status = 'PENDING' AND next_retry_at <= {_NOW4}),
r5 AS (SELECT * FROM f1x WHERE transaction_ref IN (SELECT transaction_ref FROM due)),
{O.latest_sql('r5', '5')},
{O.decisions_sql(SC.RULES, SC.RETRY_AS_OF, '5')},
{O.status_sql(SC.RULES, '5')},
tr AS (SELECT q.transaction_ref, q.attempt_count + 1 attempt, d.status es,
         d.status IN ('MATCHED', 'RESOLVED') done, d.status = 'MISMATCHED' AND q.attempt_count + 1 >= q.max_attempts exhaust
       FROM due q LEFT JOIN dec5 d USING (transaction_ref))"""


def _retry_run(spark, sf_dir, auto=None):
    t = SC.f4_tables(spark, sf_dir)
    recs = t.records.unionByName(SC.corrections(spark, sf_dir), allowMissingColumns=True)
    return RT.run_retries(ReconTables(recs, t.state, t.details, t.audit), SC.f4_queue(t.state), SC.RULES,
                          SC.RETRY_AS_OF, RetryPolicy(), auto)


@register("snk07_queue_after_run", f"""{_RUN}
SELECT q.transaction_ref, CASE WHEN done THEN 'RESOLVED' WHEN exhaust THEN 'EXHAUSTED' ELSE q.status END status,
  CAST(CASE WHEN es IS NULL AND attempt IS NULL OR done OR exhaust THEN attempt_count ELSE attempt END AS INTEGER) attempt_count,
  CASE WHEN attempt IS NULL OR done OR exhaust THEN next_retry_at
       ELSE {_NOW4} + to_seconds(CAST(least(60 * pow(2, attempt - 1), 3600) AS BIGINT)) END next_retry_at
FROM q4 q LEFT JOIN tr USING (transaction_ref)""")
def snk07_queue_after_run(spark, sf_dir):
    return _retry_run(spark, sf_dir).queue.select(M.REF, "status", "attempt_count", "next_retry_at")


@register("rt04_auto_apply_exhausted", f"""{_RUN},
win AS (SELECT transaction_ref, arg_max(source_system, (server_received_at, internal_id)) chosen FROM f1x GROUP BY 1)
SELECT q.transaction_ref, CASE WHEN done OR exhaust THEN 'RESOLVED' ELSE q.status END queue_status,
  CASE WHEN exhaust THEN 'RESOLVED' ELSE coalesce(tr.es, 'MISMATCHED') END state_status,
  CASE WHEN exhaust THEN w.chosen END chosen_source, CASE WHEN exhaust THEN 'system:retry_worker' END resolver_id
FROM q4 q LEFT JOIN tr USING (transaction_ref) LEFT JOIN win w USING (transaction_ref)""")
def rt04_auto_apply_exhausted(spark, sf_dir):
    out = _retry_run(spark, sf_dir, AutoResolveConfig(auto_apply_on_exhaustion=True, default_strategy="latest_record"))
    return (out.queue.select(M.REF, F.col("status").alias("queue_status"))
            .join(out.tables.state.select(M.REF, F.col("status").alias("state_status")), M.REF)
            .join(out.resolutions.select(M.REF, "chosen_source", "resolver_id"), M.REF, "left"))


@register("mon09_auto_resolutions_per_minute", f"""{_F4}
SELECT {_NOW4} window_start, 'latest_record' strategy,
       CASE WHEN status IN ('MISMATCHED', 'RESOLVED') THEN 'success' ELSE 'failed' END outcome,
       CAST(count(*) AS BIGINT) resolutions FROM dec4 GROUP BY ALL""")
def mon09_auto_resolutions_per_minute(spark, sf_dir):
    t = SC.f4_tables(spark, sf_dir)
    out = RS.auto_resolve(t.state.select(M.REF), t.state, t.records, t.details, SC.F4_AS_OF, strategy="latest_record")
    return MON.auto_resolutions_per_minute(out.resolutions, out.rejections, "latest_record", SC.F4_AS_OF)


_DUE_TIMEOUT = 30 * 365 * 24 * 3600


@register("jn01_due_calendar", f"""{_TWO},
old AS (SELECT transaction_ref FROM f1 GROUP BY 1
        HAVING min(server_received_at) <= {O.ts_lit(SC.PASS2_AS_OF)} - INTERVAL {_DUE_TIMEOUT} SECOND)
SELECT transaction_ref FROM due2
UNION
SELECT transaction_ref FROM s1 JOIN old USING (transaction_ref) WHERE s1.status = 'PENDING'""")
def jn01_due_calendar(spark, sf_dir):
    """Due refs, pending timeouts included, from the calendar that pass 1 wrote, the
    state and the records that landed since; the record history is not read."""
    p1 = SC.first_pass(spark, sf_dir)
    all_records = FX.f1_records(spark, sf_dir)
    late = SC.late_records(all_records)
    state = p1.tables.state
    calendar = DUE.retry_entries(state, 30).unionByName(
        DUE.timeout_entries(SC.pass1_records(all_records), _DUE_TIMEOUT)).checkpoint()
    called = DUE.due_now(calendar, SC.PASS2_AS_OF)
    limit = SC.PASS2_AS_OF - dt.timedelta(seconds=_DUE_TIMEOUT)
    waiting = called.filter(F.col("kind") == DUE.TIMEOUT).select(M.REF).unionByName(
        late.filter(F.col("server_received_at") <= F.lit(limit).cast("timestamp_ntz")).select(M.REF))
    return ST.due_refs(late, state, SC.PASS2_AS_OF, 30, landed=late, waiting=waiting, pending_timeout_secs=_DUE_TIMEOUT)
