"""Set-based engine runs (MT-15, MT-16): one plan per batch, not a loop.

The reference polls 100 refs every 5 s and issues 5+n statements per ref.
Here every due ref of a batch goes through one plan: due-set join -> group
aggregate -> CASE ladder -> state/detail/audit deltas. A ref whose amounts do
not parse lands in ``errors`` and does not stop the others.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermesh.config import MatchRules
from ledgermesh.operators import audit as A
from ledgermesh.operators import state as S
from ledgermesh.operators.matching import PENDING, REF, Reconciliation, reconcile


@dataclass
class ReconTables:
    """The engine's tables as DataFrames (T1 records, T4, T5, T6)."""
    records: DataFrame
    state: DataFrame
    details: DataFrame
    audit: DataFrame

    @classmethod
    def fresh(cls, spark: SparkSession, records: DataFrame) -> "ReconTables":
        return cls(records, S.empty_state(spark), S.empty_details(spark), A.empty_audit(spark))


@dataclass
class BatchOutcome:
    tables: ReconTables
    decisions: DataFrame
    errors: DataFrame
    audit_delta: DataFrame


def _batch_id(as_of, batch_id):
    if batch_id:
        return batch_id
    return "b-" + (as_of.isoformat() if isinstance(as_of, dt.datetime) else str(as_of))


def reconcile_batch(t: ReconTables, rules: MatchRules, as_of, backoff_secs: int = 30,
                    batch_id: str | None = None, limit: int | None = None,
                    escalate_timed_out: bool = True, materialize: bool = False,
                    landed: DataFrame | None = None) -> BatchOutcome:
    """MT-15: reconcile every due ref and return the next table snapshots.

    ``materialize=True`` checkpoints the per-ref decisions (to the shared
    checkpoint folder) so state, details, audit and errors are all derived
    from one computation instead of re-running the match for each output.
    ``landed`` (records new since the previous run) finds due refs without the
    record history; PENDING refs past the rules' timeout are due whatever their
    retries (D8) unless ``escalate_timed_out=False``.
    """
    bid = _batch_id(as_of, batch_id)
    due = S.due_refs(t.records, t.state, as_of, backoff_secs, limit,
                     rules.pending_timeout_secs if escalate_timed_out else None, landed=landed)
    return _run(t, t.state, due, rules, as_of, bid, seq=0, materialize=materialize)


def _run(t: ReconTables, state_before: DataFrame, refs: DataFrame, rules: MatchRules, as_of,
         bid: str, seq: int, materialize: bool = False, stored_base: bool = False) -> BatchOutcome:
    rec = reconcile(t.records, rules, as_of, refs=refs)
    if materialize:
        rec = Reconciliation(rec.refs.checkpoint(), rec.rules, rec.as_of)
    return apply_decisions(t, state_before, rec, bid, seq, stored_base)


def apply_decisions(t: ReconTables, state_before: DataFrame, rec: Reconciliation, bid: str, seq: int = 0,
                    stored_base: bool = False) -> BatchOutcome:
    """State, details, audit and record statuses after the decisions of ``rec``."""
    rules, as_of = rec.rules, rec.as_of
    delta = rec.state_delta()
    state2 = S.upsert_state(state_before, delta, as_of, rules.max_retries, stored_base=stored_base)
    details2 = S.upsert_details(t.details, rec.details())
    old = state_before.select(REF, F.col("status").alias("_old"))
    ad = rec.audit_details().join(old, REF, "left")
    audit_delta = A.events(ad, "MATCH_ATTEMPT", F.coalesce(F.col("_old"), F.lit("NEW")), F.col("status"),
                           F.col("details"), as_of, bid, seq)
    decided = delta.filter(F.col("status") != PENDING).select(REF, "status")
    records2 = S.propagate_status(t.records, decided)
    tables = ReconTables(records2, state2, details2, A.append_audit(t.audit, audit_delta))
    return BatchOutcome(tables, rec.refs, rec.errors(), audit_delta)


def retrigger(t: ReconTables, refs: DataFrame, rules: MatchRules, as_of,
              batch_id: str | None = None, materialize: bool = False) -> BatchOutcome:
    """MT-16: reset the refs to PENDING (audit RETRIGGER), then match them now,
    whatever their status (a RESOLVED ref can be re-opened, D10)."""
    bid = _batch_id(as_of, batch_id)
    refs = refs.select(REF).distinct()
    reset = S.reset_for_retrigger(t.state, refs, as_of)
    rt = A.events(refs, "RETRIGGER", F.lit(None), F.lit(PENDING),
                  F.lit('{"triggered_by":"grpc_ReTriggerMatch"}'), as_of, bid, 0)
    out = _run(t, reset, refs, rules, as_of, bid, seq=1, materialize=materialize)
    tables = out.tables
    tables.audit = A.append_audit(A.append_audit(t.audit, rt), out.audit_delta)
    return BatchOutcome(tables, out.decisions, out.errors, rt.unionByName(out.audit_delta))
