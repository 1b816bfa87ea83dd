"""Matcher and rule cases of the reference's unit tests, plus added edge cases."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermesh.config import MatchRules, parse_strategy
from ledgermesh.functions.tolerance import within
from ledgermesh.operators.matching import reconcile

T0 = dt.datetime(2025, 1, 1, 12, 0, 0)
SCHEMA = "transaction_ref string, source_system string, internal_id string, amount string, currency string, server_received_at timestamp_ntz"


def recs(spark, rows, ref="R1", currency="INR"):
    data = []
    for i, r in enumerate(rows):
        src, amt = r[0], r[1]
        cur = r[2] if len(r) > 2 else currency
        ts = r[3] if len(r) > 3 else T0 + dt.timedelta(seconds=i)
        data.append((ref, src, f"{src}-id", amt, cur, ts))
    return spark.createDataFrame(data, SCHEMA)


def decide(spark, rows, rules=None, as_of=T0, **kw):
    rules = rules or MatchRules(abs_tolerance="0.05", pct_tolerance=0.0)
    out = reconcile(recs(spark, rows, **kw), rules, as_of).refs.collect()
    return out[0] if out else None


def test_exact_equal_amounts_match(spark):
    assert decide(spark, [("vendor", "10000.00"), ("erp", "10000.00")]).status == "MATCHED"


def test_within_tolerance_matches(spark):
    assert decide(spark, [("vendor", "10000.00"), ("erp", "9999.98")]).status == "MATCHED"


def test_outside_tolerance_flags_one_source(spark):
    r = decide(spark, [("vendor", "10000.00"), ("erp", "9800.00")])
    assert r.status == "MISMATCHED" and r.mismatched_sources == ["erp"]


def test_single_source_is_pending(spark):
    r = decide(spark, [("vendor", "10000.00")])
    assert r.status == "PENDING" and r.reason == "only 1 source present; waiting for at least one more"


def test_majority_two_vs_one_flags_outlier(spark):
    rules = MatchRules(strategy="majority", abs_tolerance="0.05")
    r = decide(spark, [("vendor", "10000.00"), ("erp", "10000.00"), ("payment_gw", "9800.00")], rules)
    assert r.status == "MISMATCHED" and r.mismatched_sources == ["payment_gw"]  # D2
    assert r.reason == "majority strategy: 2/3 sources agree; outliers flagged"


def test_empty_input_has_no_ref(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert reconcile(df, MatchRules(), T0).refs.count() == 0


@pytest.mark.parametrize("a,b,abs_,pct,ok", [
    ("100.00", "100.00", "0.01", 0.0, True),
    ("100.00", "100.04", "0.05", 0.0, True),
    ("100.00", "100.06", "0.05", 0.0, False),
    ("10000.00", "9901.00", "0.00", 1.0, True),
    ("10000.00", "9899.00", "0.00", 1.0, False),
    ("0", "0.00", "0", 5.0, True),
])
def test_tolerance_within(spark, a, b, abs_, pct, ok):
    rules = MatchRules(abs_tolerance=abs_, pct_tolerance=pct)
    df = spark.createDataFrame([(a, b)], "a string, b string").select(
        F.col("a").cast("decimal(22,6)").alias("a"), F.col("b").cast("decimal(22,6)").alias("b"))
    assert df.select(within(F.col("a"), F.col("b"), rules).alias("w")).first().w is ok


def test_strategy_names():
    assert parse_strategy("exact") == "exact"
    assert parse_strategy("TOLERANCE") == "tolerance"
    assert parse_strategy("majority") == "majority"
    with pytest.raises(ValueError):
        parse_strategy("unknown")


def test_majority_chain_buckets(spark):
    rules = MatchRules(strategy="majority", abs_tolerance="0.05")
    r = decide(spark, [("a", "1.00"), ("b", "1.04"), ("c", "1.08")], rules)
    assert r.status == "MISMATCHED" and r.mismatched_sources == ["c"]


def test_majority_tie_all_win_and_none_win(spark):
    rows = [("a", "1.00"), ("b", "5.00")]
    assert decide(spark, rows, MatchRules(strategy="majority")).status == "MATCHED"  # D2b
    r = decide(spark, rows, MatchRules(strategy="majority", majority_ties="none_win"))
    assert r.status == "MISMATCHED" and r.mismatched_sources == ["a", "b"]


def test_null_amount_is_never_flagged(spark):
    r = decide(spark, [("a", "10.00"), ("b", None), ("c", "10.01")])
    assert r.status == "MATCHED" and r.matched_sources == ["a", "b", "c"]


def test_currency_difference_flags_all(spark):
    r = decide(spark, [("a", "10.00", "USD"), ("b", "10.00", "EUR")])
    assert r.status == "MISMATCHED" and r.mismatched_sources == ["a", "b"]
    assert r.reason == "currency mismatch: expected 'USD' (from first source), got: b=EUR"


def test_expected_source_missing_then_timeout(spark):
    rules = MatchRules(expected_sources=("a", "b", "c"), pending_timeout_secs=300)
    rows = [("a", "10.00"), ("b", "10.00")]
    r = decide(spark, rows, rules, as_of=T0 + dt.timedelta(seconds=100))
    assert r.status == "PENDING"
    assert r.reason == 'waiting for sources: ["a", "b", "c"]; present: ["a", "b"]'
    r = decide(spark, rows, rules, as_of=T0 + dt.timedelta(seconds=400))
    assert r.status == "MISMATCHED" and r.mismatched_sources == []
    assert r.reason == "pending timeout after 400s — missing sources: c"


def test_single_source_times_out(spark):
    r = decide(spark, [("a", "10.00")], MatchRules(pending_timeout_secs=300), as_of=T0 + dt.timedelta(hours=1))
    assert r.status == "MISMATCHED"
    assert r.reason == "only 1 source present after 3600s timeout (minimum 2 required)"


def test_superseded_record_loses_to_latest(spark):
    rows = [("a", "10.00", "INR", T0), ("b", "99.00", "INR", T0), ("b", "10.00", "INR", T0 + dt.timedelta(minutes=1))]
    data = [("R1", s, f"{s}-{i}", a, c, t) for i, (s, a, c, t) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    r = reconcile(df, MatchRules(abs_tolerance="0.05"), T0).refs.first()
    assert r.status == "MATCHED" and r.record_count == 3 and r.source_count == 2


def test_zero_reference_with_pct(spark):
    r = decide(spark, [("a", "0"), ("b", "0.01")], MatchRules(abs_tolerance="0", pct_tolerance=50.0))
    assert r.status == "MISMATCHED"


def test_bad_amount_is_an_error_not_a_state(spark):
    rec = reconcile(recs(spark, [("a", "10.00"), ("b", "12,50")]), MatchRules(), T0)
    assert rec.state_delta().count() == 0
    e = rec.errors().first()
    assert (e.error_source, e.error_value) == ("b", "12,50")


def test_result_independent_of_input_order(spark):
    rows = [("a", "1.00"), ("b", "1.04"), ("c", "1.08"), ("d", "1.03")]
    rules = MatchRules(strategy="majority", abs_tolerance="0.05")
    df = recs(spark, rows)
    one = reconcile(df, rules, T0).details().orderBy("system_name").collect()
    two = reconcile(df.repartition(3).orderBy(F.rand(7)), rules, T0).details().orderBy("system_name").collect()
    assert one == two


def test_details_json_per_strategy(spark):
    rec = reconcile(recs(spark, [("a", "10.00"), ("b", "12.00")]), MatchRules(strategy="exact"), T0)
    d = {r.system_name: r.discrepancy_details for r in rec.details().collect()}
    assert d["a"] is None
    assert d["b"] == '{"actual":"12.000000","diff":"2.000000","reference":"10.000000","strategy":"exact"}'


def test_audit_payload(spark):
    rec = reconcile(recs(spark, [("a", "10.00"), ("b", "10.00")]), MatchRules(), T0)
    p = rec.audit_details().first().details
    assert p.startswith('{"currency":"INR","outcome":"MATCHED","reference_amount":"10.000000","sources":[')


def test_decimal_precision_guard(spark):
    from ledgermesh.functions.amounts import amount_error, parse_amount
    df = spark.createDataFrame([("10.1234567",), (" 100 ",), ("1e3",), ("12.50",)], "t string")
    out = df.select(parse_amount(F.col("t")).alias("a"), amount_error(F.col("t")).alias("e")).collect()
    assert out[0].e == "amount_precision" and out[0].a is None
    assert out[1].e == "invalid_amount"
    assert out[2].a == Decimal("1000.000000")
    assert out[3].a == Decimal("12.500000") and out[3].e is None


def test_what_a_lambda_reads_is_evaluated_once(spark):
    """The first currency and the comparison are no part of the lambdas that read them."""
    from ledgermesh.operators.matching import reconcile as run
    df = spark.createDataFrame([("R", "a", "1", "10.00", "USD"), ("R", "b", "2", "12.50", "USD"), ("Q", "a", "3", "1", None),
                                ("Q", "b", "4", None, "USD"), ("Q", "c", "5", "1", "EUR")],
                               "transaction_ref string, source_system string, internal_id string, amount string, currency string"
                               ).withColumn("server_received_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    rec = run(df, MatchRules(strategy="tolerance", abs_tolerance="0.05", pct_tolerance=0.01), dt.datetime(2024, 1, 2))
    plan = rec.refs._jdf.queryExecution().optimizedPlan().toString()
    # once for the reference currency, none within the lambda that compares with it
    assert len(re.findall(r"isnotnull\(lambda x_\d+#\d+\.currency\), lambda", plan)) == 1, plan
    assert plan.count("0.0001000000") == 1, plan
    got = {r.transaction_ref: r for r in rec.refs.collect()}
    assert got["Q"].gate == "currency" and got["Q"].reason == "currency mismatch: expected 'USD' (from first source), got: c=EUR"
    assert [r.discrepancy_details for r in got["R"].results] == [None, (
        '{"absolute_tolerance":"0.05","actual":"12.500000","diff":"2.500000","pct_tolerance":0.01,'
        '"reference":"10.000000","strategy":"tolerance"}')]
