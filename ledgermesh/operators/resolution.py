"""Conflict resolution (RS-2..8, WN-2..5, AG-4, SNK-6, STA-2).

Every strategy is a per-ref aggregate (``max_by``/``min_by``, partial and
skew-safe) or an array lookup over the ref's present sources; a batch of refs
is resolved by one plan. Refs that cannot be resolved come out as
``rejections(transaction_ref, reason)`` rather than exceptions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgermesh.config import AutoResolveConfig
from ledgermesh.functions.times import as_ts
from ledgermesh.operators import audit as A
from ledgermesh.operators import state as S
from ledgermesh.operators.matching import MATCHED, MISMATCHED, PENDING, REF, RESOLVED, latest_per_source

# Strategy names and their aliases.
STRATEGIES = ("source_priority", "latest_record", "highest_amount", "lowest_amount", "first_submitted")
ALIASES = {"latest": "latest_record", "": "latest_record", "highest": "highest_amount",
           "lowest": "lowest_amount", "first": "first_submitted"}

RESOLUTION_SCHEMA = ("transaction_ref string, resolution_type string, chosen_source string, "
                     "resolution_reason string, resolver_id string, strategy string, resolved_at timestamp_ntz")
RESOLUTION_COLUMNS = [f.split()[0] for f in RESOLUTION_SCHEMA.split(", ")]


def parse_strategy(name: str | None) -> str:
    s = (name or "").strip().lower()
    s = ALIASES.get(s, s)
    if s not in STRATEGIES:
        raise ValueError(f"unsupported strategy: {name}")
    return s


def split_priority(text: str) -> list[str]:
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def present_sources(records: DataFrame) -> DataFrame:
    """AG-4: distinct sources per ref (sorted)."""
    return records.groupBy(REF).agg(F.array_sort(F.collect_set("source_system")).alias("present_sources"))


def _q(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


def pick(records: DataFrame, details: DataFrame, strategy: str, source_priority: str = "") -> DataFrame:
    """Winner per ref: ``transaction_ref, chosen_source, reason, failure``.

    latest/first read all records (superseded included, ties by internal_id);
    highest/lowest read the match details with a non-null amount (D11: the
    column is ``system_name``); source_priority takes the first listed source
    that is present.
    """
    strategy = parse_strategy(strategy)
    order = F.struct("server_received_at", "internal_id")
    if strategy in ("latest_record", "first_submitted"):
        agg = F.max_by if strategy == "latest_record" else F.min_by
        out = records.groupBy(REF).agg(agg("source_system", order).alias("chosen_source"))
        fmt = ("latest_record: %s submitted most recently" if strategy == "latest_record"
               else "first_submitted: %s submitted earliest")
        return out.select(REF, "chosen_source", F.format_string(fmt, _q(F.col("chosen_source"))).alias("reason"),
                          F.lit(None).cast("string").alias("failure"))
    if strategy in ("highest_amount", "lowest_amount"):
        hi = strategy == "highest_amount"
        label = "highest" if hi else "lowest"
        agg = F.max_by if hi else F.min_by
        d = details.filter(F.col("amount").isNotNull())
        won = d.groupBy(REF).agg(agg("system_name", F.struct("amount", "system_name")).alias("chosen_source"))
        refs = records.select(REF).distinct()
        j = refs.join(won, REF, "left")
        return j.select(
            REF, "chosen_source",
            F.when(F.col("chosen_source").isNotNull(), F.format_string(
                f"{label}_amount: %s reports the {label} amount", _q(F.col("chosen_source")))).alias("reason"),
            F.when(F.col("chosen_source").isNull(), F.format_string(
                "resolution strategy failed to determine a winner: no amount data found for transaction %s",
                _q(F.col(REF)))).alias("failure"))
    prio = split_priority(source_priority)
    if not prio:
        raise ValueError("source_priority strategy requires 'source_priority' config key (comma-separated list)")
    ps = present_sources(records)
    plist = F.array(*[F.lit(p) for p in prio])
    chosen = F.get(F.filter(plist, lambda x: F.array_contains(F.col("present_sources"), x)), 0)
    plist_txt = ", ".join(prio)
    return ps.select(
        REF, chosen.alias("chosen_source"),
        F.when(chosen.isNotNull(), F.format_string(
            f"source_priority: %s is highest-priority source present (priority list: [{plist_txt}])",
            _q(chosen))).alias("reason"),
        F.when(chosen.isNull(), F.format_string(
            f"resolution strategy failed to determine a winner: none of the priority sources [{' '.join(prio)}] "
            "have submitted a record for %s (present: [%s])", _q(F.col(REF)),
            F.array_join("present_sources", " "))).alias("failure"))


@dataclass
class ResolutionOutcome:
    resolutions: DataFrame     # T7 rows written by this run
    state: DataFrame           # next T4 snapshot
    audit_delta: DataFrame     # AUTO_RESOLUTION / MANUAL_RESOLUTION rows
    rejections: DataFrame      # transaction_ref, reason
    queue: DataFrame | None = None  # next retry queue snapshot, when one was given


def mark_queue_resolved(queue: DataFrame, refs: DataFrame, as_of) -> DataFrame:
    """A resolved ref's retry-queue row (if any) becomes RESOLVED."""
    hit = refs.select(REF).distinct().withColumn("_hit", F.lit(True))
    j = queue.join(hit, REF, "left")
    h = F.coalesce(F.col("_hit"), F.lit(False))
    cols = [F.when(h, F.lit(RESOLVED)).otherwise(F.col(c)).alias(c) if c == "status"
            else F.when(h, as_ts(as_of)).otherwise(F.col(c)).alias(c) if c == "updated_at"
            else F.col(c) for c in queue.columns]
    return j.select(*cols)


def upsert_resolutions(base: DataFrame, delta: DataFrame) -> DataFrame:
    """SNK-6: last decision per ref wins."""
    kept = base.join(delta.select(REF), REF, "left_anti")
    return kept.select(*RESOLUTION_COLUMNS).unionByName(delta.select(*RESOLUTION_COLUMNS))


def auto_resolve(refs: DataFrame, state: DataFrame, records: DataFrame, details: DataFrame, as_of,
                 strategy: str | None = None, cfg: AutoResolveConfig | None = None,
                 resolver_id: str | None = None, batch_id: str = "auto", parity: bool = False,
                 queue: DataFrame | None = None) -> ResolutionOutcome:
    """RS-6: resolve MISMATCHED (or again RESOLVED) refs by strategy."""
    cfg = cfg or AutoResolveConfig()
    strat = parse_strategy(strategy if strategy is not None else cfg.default_strategy)
    rid = resolver_id or cfg.resolver_id
    r = refs.select(REF).distinct()
    j = r.join(state.select(REF, F.col("status").alias("old_status")), REF, "left")
    eligible = j.filter(F.col("old_status").isin(MISMATCHED, RESOLVED))
    bad_status = j.filter(~F.coalesce(F.col("old_status").isin(MISMATCHED, RESOLVED), F.lit(False))).select(
        REF, F.when(F.col("old_status").isNull(), F.lit("transaction not found"))
        .otherwise(F.format_string("cannot resolve transaction in status %s", F.col("old_status"))).alias("reason"))
    recs = records.join(eligible.select(REF), REF, "left_semi")
    dets = details.join(eligible.select(REF), REF, "left_semi")
    won = eligible.join(pick(recs, dets, strat, cfg.source_priority), REF, "left")
    ok = won.filter(F.col("chosen_source").isNotNull())
    failed = won.filter(F.col("chosen_source").isNull()).select(
        REF, F.coalesce("failure", F.lit("no source records found for transaction")).alias("reason"))
    now = as_ts(as_of)
    res = ok.select(REF, F.lit("AUTO").alias("resolution_type"), "chosen_source",
                    F.col("reason").alias("resolution_reason"), F.lit(rid).alias("resolver_id"),
                    F.lit(strat).alias("strategy"), now.alias("resolved_at"))
    new_state = S.mark_resolved(state, ok.select(REF), as_of, parity=parity)
    details_json = F.to_json(F.struct(F.col("chosen_source"), F.col("reason"), F.lit(rid).alias("resolver_id"),
                                      F.lit(strat).alias("strategy")))
    audit = A.events(ok, "AUTO_RESOLUTION", F.col("old_status"), F.lit(RESOLVED), details_json, as_of, batch_id)
    q = None if queue is None else mark_queue_resolved(queue, ok.select(REF), as_of)
    return ResolutionOutcome(res, new_state, audit, bad_status.unionByName(failed), q)


def resolve_manually(decisions: DataFrame, state: DataFrame, as_of, batch_id: str = "manual",
                     parity: bool = False, queue: DataFrame | None = None) -> ResolutionOutcome:
    """RS-7: apply manual decisions (``transaction_ref, chosen_source,
    resolver_id`` [, ``reason``, ``decided_at``]). The last decision per ref
    by ``decided_at`` wins, of equal times the greatest by source, resolver and
    reason; PENDING/MATCHED and unknown refs are rejected; the chosen source is
    not checked for presence (as in the reference)."""
    cols = decisions.columns
    d = decisions.select(
        F.coalesce(F.col(REF), F.lit("")).alias(REF),
        F.coalesce(F.col("chosen_source"), F.lit("")).alias("chosen_source"),
        F.coalesce(F.col("resolver_id"), F.lit("")).alias("resolver_id"),
        (F.col("reason") if "reason" in cols else F.lit("")).alias("reason"),
        (F.col("decided_at").cast("timestamp_ntz") if "decided_at" in cols else as_ts(as_of)).alias("decided_at"))
    missing = d.filter((F.col(REF) == "") | (F.col("chosen_source") == "") | (F.col("resolver_id") == "")).select(
        REF, F.lit("missing_field: transaction_ref, chosen_source and resolver_id are required").alias("reason"))
    valid = d.filter((F.col(REF) != "") & (F.col("chosen_source") != "") & (F.col("resolver_id") != ""))
    last = valid.groupBy(REF).agg(F.max_by(F.struct("chosen_source", "resolver_id", "reason"),
                                           F.struct("decided_at", "chosen_source", "resolver_id", "reason")).alias("_d"))
    j = last.join(state.select(REF, F.col("status").alias("old_status")), REF, "left")
    rejected = j.filter(~F.coalesce(F.col("old_status").isin(MISMATCHED, RESOLVED), F.lit(False))).select(
        REF, F.when(F.col("old_status").isNull(), F.lit("not_found: transaction not found"))
        .otherwise(F.format_string("invalid_status: cannot resolve transaction in status %s",
                                   F.col("old_status"))).alias("reason"))
    ok = j.filter(F.col("old_status").isin(MISMATCHED, RESOLVED))
    now = as_ts(as_of)
    res = ok.select(REF, F.lit("MANUAL").alias("resolution_type"), F.col("_d.chosen_source").alias("chosen_source"),
                    F.col("_d.reason").alias("resolution_reason"), F.col("_d.resolver_id").alias("resolver_id"),
                    F.lit(None).cast("string").alias("strategy"), now.alias("resolved_at"))
    new_state = S.mark_resolved(state, ok.select(REF), as_of, parity=parity)
    details_json = F.to_json(F.struct(F.col("_d.chosen_source").alias("chosen_source"),
                                      F.col("_d.reason").alias("reason"),
                                      F.col("_d.resolver_id").alias("resolver_id")))
    audit = A.events(ok, "MANUAL_RESOLUTION", F.col("old_status"), F.lit(RESOLVED), details_json, as_of, batch_id)
    q = None if queue is None else mark_queue_resolved(queue, ok.select(REF), as_of)
    return ResolutionOutcome(res, new_state, audit, missing.unionByName(rejected), q)


def golden_records(resolutions: DataFrame, records: DataFrame) -> DataFrame:
    """RS-8: the chosen source's surviving record per resolved ref, with its payload
    where the records carry one (``raw_payload`` or ``payload_text``)."""
    mine = resolutions.select(REF, "chosen_source", "resolution_type", "resolver_id")
    same = [F.col("chosen_source") == F.col("source_system")]
    wanted = records.join(mine.select(F.col(REF).alias("_ref"), "chosen_source"),
                          [F.col(REF) == F.col("_ref"), *same], "left_semi")
    payload = [c for c in ("raw_payload", "payload_text") if c in records.columns]
    latest = latest_per_source(wanted).withColumnRenamed("source_system", "chosen_source")
    out = mine.join(latest, [REF, "chosen_source"], "left")
    columns = [REF, "chosen_source", "resolution_type", "resolver_id", "internal_id", "amount", "currency",
               "server_received_at"]
    if payload:  # of equal records one; the payload is fetched for the records that survived
        body = wanted.groupBy(F.col(REF).alias("_ref"), F.col("internal_id").alias("_id"),
                              F.col("server_received_at").alias("_at")).agg(*[F.max(c).alias(c) for c in payload])
        out = out.join(body, (F.col(REF) == F.col("_ref")) & F.col("internal_id").eqNullSafe(F.col("_id"))
                       & F.col("server_received_at").eqNullSafe(F.col("_at")), "left")
    return out.select(*columns, *payload)


__all__ = ["parse_strategy", "pick", "present_sources", "auto_resolve", "resolve_manually",
           "golden_records", "upsert_resolutions", "PENDING", "MATCHED"]
