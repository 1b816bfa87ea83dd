"""Reconciliation matching (MT-0 .. MT-14, WN-1, WN-6, AG-1..3, AG-7, JN-6).

Plan shape, for any strategy:

1. ``latest_per_source``: ``groupBy(ref, source)`` with ``max_by`` — a partial
   (map-side) aggregate, so a hot (ref, source) pair holding millions of
   superseded records is collapsed before the shuffle.
2. ``groupBy(ref)``: one row per ref with the ref's surviving records as a
   sorted array. After step 1 that array has one element per *source system*,
   so its size is bounded by the number of systems feeding the ref, never by
   the number of records.
3. Gates, currency check and the strategy are one CASE ladder over that row
   (higher-order functions on a handful of elements, no Python).

Group order (which record is "first") is ``(server_received_at, source_system)``
of the surviving records, so results do not depend on partitioning or input
order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ledgermesh.config import MatchRules, format_f64
from ledgermesh.functions.amounts import AMOUNT_SQL, parse_amount
from ledgermesh.functions.binding import let
from ledgermesh.functions.jsonfmt import jarray, jbool, jdecimal, jnum, jobject, jraw, jstr, rust_debug_list
from ledgermesh.functions.times import age_seconds, as_ts
from ledgermesh.functions.tolerance import within

REF = "transaction_ref"
SRC = "source_system"
TS = "server_received_at"

PENDING, MATCHED, MISMATCHED, RESOLVED, ERROR = "PENDING", "MATCHED", "MISMATCHED", "RESOLVED", "ERROR"

_RESULT_TYPE = (
    "struct<source_system:string,internal_id:string,amount:decimal(22,6),currency:string,"
    "discrepancy_found:boolean,discrepancy_details:string>"
)


def canonical_records(records: DataFrame) -> DataFrame:
    """Project the columns the matcher reads (RecordView).

    ``amount`` may be text (parsed strictly, the text kept as ``amount_text``)
    or already DECIMAL(22,6).
    """
    cols = set(records.columns)
    amount_is_text = isinstance(records.schema["amount"].dataType, StringType)
    if amount_is_text:
        amount_text = F.nullif(F.col("amount"), F.lit(""))
        amount = parse_amount(amount_text)
    else:
        amount_text = F.col("amount_text") if "amount_text" in cols else F.lit(None).cast("string")
        amount = F.col("amount").cast(AMOUNT_SQL)
    currency = F.col("currency") if "currency" in cols else F.lit(None).cast("string")
    return records.select(
        F.col(REF), F.col(SRC), F.col("internal_id"), amount.alias("amount"),
        currency.alias("currency"), F.col(TS).cast("timestamp_ntz").alias(TS),
        amount_text.alias("amount_text"),
    )


def latest_per_source(records: DataFrame) -> DataFrame:
    """WN-1: the last received record of each (ref, source) wins; ties on
    ``server_received_at`` are broken by ``internal_id`` (D18).

    Also carries ``n_records`` (superseded records included) and the earliest
    arrival, which ``record_count`` and ``first_seen_at`` need (AG-2, AG-3).
    """
    rec = canonical_records(records)
    payload = F.struct("internal_id", "amount", "currency", TS, "amount_text")
    return (
        rec.groupBy(REF, SRC)
        .agg(F.max_by(payload, F.struct(TS, "internal_id")).alias("_r"),
             F.count(F.lit(1)).alias("n_records"),
             F.min(TS).alias("first_seen_src"))
        .select(REF, SRC, "_r.internal_id", "_r.amount", "_r.currency", f"_r.{TS}",
                "_r.amount_text", "n_records", "first_seen_src")
    )


def group_records(latest: DataFrame) -> DataFrame:
    """AG-1: one row per ref with its surviving records sorted in group order."""
    elem = F.struct(F.col(TS).alias("ts"), F.col(SRC).alias("source_system"), "internal_id",
                    "amount", "currency", "amount_text")
    return latest.groupBy(REF).agg(
        F.array_sort(F.collect_list(elem)).alias("recs"),
        F.sum("n_records").alias("record_count"),
        F.min("first_seen_src").alias("first_seen_at"),
    )


# ──────────────────────────────────────────────────────────────────────────
# strategy helpers (Column expressions over the sorted ``recs`` array)
# ──────────────────────────────────────────────────────────────────────────

def _first_non_null(arr: Column, field: str) -> Column:
    return F.get(F.filter(arr, lambda x: x[field].isNotNull()), 0)[field]


def _result(x: Column, flagged: Column, details: Column) -> Column:
    return F.struct(
        x["source_system"].alias("source_system"), x["internal_id"].alias("internal_id"),
        x["amount"].alias("amount"), x["currency"].alias("currency"),
        flagged.alias("discrepancy_found"), details.alias("discrepancy_details"),
    )


def _compare_to_reference(recs: Column, ref_amt: Column, rules: MatchRules) -> Column:
    """MT-8 / MT-9: each amount against the reference amount."""
    def one(x):
        a = x["amount"]
        if rules.strategy == "exact":
            flagged = F.coalesce(a != ref_amt, F.lit(False))
            details = jobject(
                ("actual", jdecimal(a)),
                ("diff", jdecimal(F.abs(a - ref_amt))),
                ("reference", jdecimal(ref_amt)),
                ("strategy", F.lit('"exact"')),
            )
        else:  # equal amounts are within any tolerance: most records need no arithmetic
            flagged = F.coalesce((a != ref_amt) & ~within(a, ref_amt, rules), F.lit(False))
            details = jobject(
                ("absolute_tolerance", F.lit('"' + rules.abs_text + '"')),
                ("actual", jdecimal(a)),
                ("diff", jdecimal(F.abs(a - ref_amt))),
                ("pct_tolerance", F.lit(repr(float(rules.pct_tolerance)))),
                ("reference", jdecimal(ref_amt)),
                ("strategy", F.lit('"tolerance"')),
            )
        return let(flagged, lambda f: _result(x, f, F.when(f, details)))
    return F.transform(recs, one)


def _majority(recs: Column, rules: MatchRules) -> Column:
    """MT-10 greedy bucketing in group order, as one fold.

    A record joins the first bucket whose representative (first member) is
    within tolerance; a NULL amount always opens its own bucket. The fold's
    ``finish`` step builds the per-source results from the accumulator, so the
    fold is evaluated once per ref (consumers never re-run it per element).
    Returns ``struct<results, majority_amount, max_size>``.
    """
    item_t = "struct<source_system:string,internal_id:string,amount:decimal(22,6),currency:string,k:int>"
    init = F.struct(
        F.array().cast("array<struct<rep:decimal(22,6),size:int>>").alias("b"),
        F.array().cast(f"array<{item_t}>").alias("items"),
    )

    def step(acc, x):
        b, items = acc["b"], acc["items"]
        amt = x["amount"]
        hits = F.transform(b, lambda bb: F.coalesce(bb["rep"].isNotNull() & within(amt, bb["rep"], rules),
                                                      F.lit(False)))
        pos = F.when(amt.isNotNull(), F.array_position(hits, True)).otherwise(F.lit(0)).cast("int")
        new_bucket = F.array(F.struct(amt.alias("rep"), F.lit(1).alias("size")))
        grown = F.transform(b, lambda bb, j: F.when(j == pos - 1,
                                                     F.struct(bb["rep"].alias("rep"),
                                                              (bb["size"] + 1).alias("size")))
                            .otherwise(bb))

        def item(k):
            return F.array(F.struct(x["source_system"].alias("source_system"),
                                    x["internal_id"].alias("internal_id"), amt.alias("amount"),
                                    x["currency"].alias("currency"), k.cast("int").alias("k")))
        return F.when(pos == 0, F.struct(F.concat(b, new_bucket).alias("b"),
                                         F.concat(items, item(F.size(b))).alias("items"))) \
                .otherwise(F.struct(grown.alias("b"), F.concat(items, item(pos - 1)).alias("items")))

    def finish(acc):
        b, items = acc["b"], acc["items"]
        max_size = F.array_max(F.transform(b, lambda bb: bb["size"]))
        n_max = F.size(F.filter(b, lambda bb: bb["size"] == max_size))
        ties_lose = F.lit(rules.majority_ties == "none_win") & (n_max > 1)

        def wins(it):
            return (F.get(b, it["k"])["size"] == max_size) & ~ties_lose

        majority_amount = F.get(F.filter(items, wins), 0)["amount"]

        def one(it):
            flagged = ~wins(it)
            details = jobject(
                ("actual", jstr(it["amount"])),
                ("bucket_size", jnum(F.get(b, it["k"])["size"])),
                ("majority_amount", jstr(majority_amount)),
                ("strategy", F.lit('"majority"')),
                ("winning_bucket_size", jnum(max_size)),
            )
            return _result(it, flagged, F.when(flagged, details))

        return F.struct(F.transform(items, one).alias("results"), majority_amount.alias("majority_amount"),
                        max_size.alias("max_size"))

    return F.aggregate(recs, init, step, finish)


# ──────────────────────────────────────────────────────────────────────────
# reconcile
# ──────────────────────────────────────────────────────────────────────────

@dataclass
class Reconciliation:
    """Outputs of one ``reconcile`` run; every member is a lazy DataFrame.

    ``refs`` holds one decision per ref. Callers that use several outputs of
    the same run should ``persist()``/``checkpoint()`` ``refs`` once.
    """

    refs: DataFrame
    rules: MatchRules
    as_of: object

    def decisions(self) -> DataFrame:
        """Status per ref (ERROR rows excluded). Filters on the cheap ``gate``
        column: a filter on ``status`` would be pushed below the decision
        projection and evaluate the strategy twice."""
        return self.refs.filter(F.col("gate") != "error")

    def state_delta(self) -> DataFrame:
        """SNK-3 input: the new state columns of every decided ref."""
        return self.decisions().select(
            REF, "status", "reason", "record_count", "source_count",
            "matched_sources", "mismatched_sources", "first_seen_at",
            "reference_amount", "currency",
        )

    def details(self) -> DataFrame:
        """T5 rows (MT-14): one per source of each non-PENDING decided ref."""
        # PENDING and ERROR refs carry an empty ``results`` array, so no filter
        # is needed (a filter on ``status`` would be pushed below the decision
        # projection and re-evaluate the strategy inside the predicate)
        return (
            self.refs.select(REF, F.explode("results").alias("r"))
            .select(REF, F.col("r.source_system").alias("system_name"), "r.internal_id",
                    "r.amount", "r.currency", "r.discrepancy_found", "r.discrepancy_details",
                    as_ts(self.as_of).alias("processed_at"))
        )

    def errors(self) -> DataFrame:
        """MT-5 / D20: refs whose amounts did not parse; no state is written."""
        return self.refs.filter(F.col("gate") == "error").select(
            REF, F.col("error_source"), F.col("error_value"),
            F.lit("invalid_amount").alias("error"), as_ts(self.as_of).alias("failed_at"))

    def audit_details(self) -> DataFrame:
        """MT-13: the audit payload per decided ref (``details`` JSON text)."""
        src_matched = F.transform("results", lambda r: jobject(
            ("amount", jstr(r["amount"])), ("system", jstr(r["source_system"]))))
        src_mismatched = F.transform("results", lambda r: jobject(
            ("amount", jstr(r["amount"])), ("details", jraw(r["discrepancy_details"])),
            ("discrepancy", jbool(r["discrepancy_found"])), ("system", jstr(r["source_system"]))))
        payload = (
            F.when(F.col("status") == MATCHED, jobject(
                ("currency", jstr(F.col("currency"))), ("outcome", F.lit('"MATCHED"')),
                ("reference_amount", jstr(F.col("reference_amount"))),
                ("sources", jarray(src_matched))))
            .when(F.col("status") == MISMATCHED, jobject(
                ("outcome", F.lit('"MISMATCHED"')), ("reason", jstr(F.col("reason"))),
                ("sources", jarray(src_mismatched))))
            .otherwise(jobject(
                ("outcome", F.lit('"PENDING"')), ("reason", jstr(F.col("reason"))),
                ("record_count", jnum(F.col("source_count")))))
        )
        return self.decisions().select(REF, "status", payload.alias("details"))


def decide(grouped: DataFrame, rules: MatchRules, as_of) -> DataFrame:
    """MT-0 ladder over ``group_records`` output."""
    recs = F.col("recs")
    now = as_ts(as_of)
    present = F.transform(recs, lambda x: x["source_system"])
    expected = F.array(*[F.lit(s) for s in rules.expected_sources]) if rules.expected_sources \
        else F.array().cast("array<string>")
    missing = F.filter(expected, lambda e: ~F.array_contains(F.col("present_sources"), e))
    age = age_seconds(now, F.col("first_seen_at"))
    if rules.pending_timeout_secs is None:  # escalation disabled
        timed_out = F.lit(False)
    else:
        timed_out = age >= F.lit(int(rules.pending_timeout_secs))

    ref_amount = _first_non_null(recs, "amount")
    first_currency = _first_non_null(recs, "currency")
    cur_bad = F.filter(recs, lambda x: x["currency"].isNotNull() & (x["currency"] != F.col("_first_currency")))
    cur_detail = F.format_string(
        "expected '%s' (from first source), got: %s", F.col("_first_currency"),
        F.array_join(F.transform("_cur_bad", lambda x: F.concat(x["source_system"], F.lit("="),
                                                                x["currency"])), ", "))
    bad = F.filter(recs, lambda x: x["amount_text"].isNotNull() & x["amount"].isNull())

    g = grouped.select(
        REF, "recs", "record_count", "first_seen_at",
        F.size(recs).alias("source_count"),
        present.alias("present_sources"),
        age.alias("age_secs"),
        timed_out.alias("timed_out"),
        ref_amount.alias("_ref_amount"),
        first_currency.alias("_first_currency"),
        F.get(bad, 0).alias("_bad"),
    )
    # projections of their own: what a lambda reads is not worked out again for every element
    g = g.withColumn("_cur_bad", cur_bad).withColumn("missing_sources", missing)
    g = g.withColumn("_currency_detail", F.when(F.size("_cur_bad") > 0, cur_detail))  # the text only where it is read

    gate = (
        F.when(F.size("missing_sources") > 0, F.when(F.col("timed_out"), F.lit("missing_timeout"))
               .otherwise(F.lit("missing_wait")))
        .when(F.col("source_count") < 2, F.when(F.col("timed_out"), F.lit("single_timeout"))
              .otherwise(F.lit("single_wait")))
        .when(F.col("_bad").isNotNull(), F.lit("error"))
        .when(F.size("_cur_bad") > 0, F.lit("currency"))
        .otherwise(F.lit("compare"))
    )
    g = g.withColumn("_gate", gate)

    # strategy results
    if rules.strategy == "majority":
        g = g.withColumn("_maj", _majority(recs, rules))
        cmp_results = F.col("_maj.results")
        cmp_ref_amount = F.col("_maj.majority_amount")
        cmp_reason = F.format_string("majority strategy: %d/%d sources agree; outliers flagged",
                                     F.col("_maj.max_size"), F.col("source_count"))
    else:
        cmp_results = _compare_to_reference(recs, F.col("_ref_amount"), rules)
        cmp_ref_amount = F.col("_ref_amount")
        if rules.strategy == "exact":
            cmp_reason = F.lit("exact match strategy: amounts differ")
        else:
            cmp_reason = F.lit("tolerance strategy: amounts deviate beyond abs=%s / pct=%s%%"
                               % (rules.abs_text, format_f64(rules.pct_tolerance)))

    plain = F.transform(recs, lambda x: _result(x, F.lit(False), F.lit(None).cast("string")))
    currency_results = F.transform(recs, lambda x: _result(
        x, F.lit(True), jobject(("currency_mismatch", jstr(F.col("_currency_detail"))))))
    g = g.withColumn("_cmp", cmp_results)
    any_flag = F.exists(F.col("_cmp"), lambda r: r["discrepancy_found"])

    gate_c = F.col("_gate")
    status = (
        F.when(gate_c.isin("missing_wait", "single_wait"), F.lit(PENDING))
        .when(gate_c.isin("missing_timeout", "single_timeout", "currency"), F.lit(MISMATCHED))
        .when(gate_c == "error", F.lit(ERROR))
        .when(any_flag, F.lit(MISMATCHED))
        .otherwise(F.lit(MATCHED))
    )
    reason = (
        F.when(gate_c == "missing_timeout", F.format_string(
            "pending timeout after %ds — missing sources: %s", F.col("age_secs"),
            F.array_join("missing_sources", ", ")))
        .when(gate_c == "missing_wait", F.concat(
            F.lit("waiting for sources: "), rust_debug_list(expected), F.lit("; present: "),
            rust_debug_list(F.col("present_sources"))))
        .when(gate_c == "single_timeout", F.format_string(
            "only 1 source present after %ds timeout (minimum 2 required)", F.col("age_secs")))
        .when(gate_c == "single_wait", F.lit("only 1 source present; waiting for at least one more"))
        .when(gate_c == "error", F.lit(None).cast("string"))
        .when(gate_c == "currency", F.concat(F.lit("currency mismatch: "), F.col("_currency_detail")))
        .when(any_flag, cmp_reason)
    )
    results = (
        F.when(gate_c.isin("missing_wait", "single_wait", "error"),
               F.array().cast(f"array<{_RESULT_TYPE}>"))
        .when(gate_c.isin("missing_timeout", "single_timeout"), plain)
        .when(gate_c == "currency", currency_results)
        .otherwise(F.col("_cmp"))
    )
    out = g.select(
        REF, status.alias("status"), reason.alias("reason"), F.col("_gate").alias("gate"),
        "record_count", "source_count",
        "first_seen_at", "present_sources", "missing_sources", "age_secs",
        results.alias("results"), cmp_ref_amount.alias("_cmp_ref_amount"),
        F.col("_first_currency"),
        F.col("_bad.source_system").alias("error_source"),
        F.col("_bad.amount_text").alias("error_value"),
    )
    names = F.transform("results", lambda r: r["source_system"])
    flagged_names = F.transform(F.filter("results", lambda r: r["discrepancy_found"]),
                                lambda r: r["source_system"])
    empty = F.array().cast("array<string>")
    return out.select(
        REF, "status", "reason", "gate", "record_count", "source_count", "first_seen_at",
        "present_sources", "missing_sources", "age_secs",
        F.when(F.col("status") == MATCHED, F.array_sort(names)).otherwise(empty).alias("matched_sources"),
        F.when(F.col("status") == MISMATCHED, F.array_sort(flagged_names)).otherwise(empty)
        .alias("mismatched_sources"),
        F.when(F.col("status") == MATCHED, F.col("_cmp_ref_amount")).alias("reference_amount"),
        # MT-8 / MT-9: without any amount there is nothing that the currency belongs to
        F.when((F.col("status") == MATCHED)
               & (F.exists("results", lambda r: r["amount"].isNotNull()) if rules.strategy != "majority" else F.lit(True)),
               F.col("_first_currency")).alias("currency"),
        "results", "error_source", "error_value",
    )


def reconcile(records: DataFrame, rules: MatchRules | None = None, as_of=None,
              refs: DataFrame | None = None) -> Reconciliation:
    """MT-0: decide every ref present in ``records`` (and in ``refs``, if
    given) as of ``as_of``.

    ``refs`` is joined after the records are collapsed to one row per (ref,
    source), which happens map-side first: a ref with a third of all records
    reaches the join as a handful of rows.

    ``records`` needs ``transaction_ref, source_system, internal_id, amount,
    currency, server_received_at`` (``amount`` as DECIMAL(22,6) or text).
    """
    rules = rules or MatchRules()
    if as_of is None:
        raise ValueError("as_of is required (results must be reproducible)")
    latest = latest_per_source(records)
    if refs is not None:
        latest = latest.join(refs.select(REF), REF, "left_semi")
    grouped = group_records(latest)
    return Reconciliation(decide(grouped, rules, as_of), rules, as_of)
