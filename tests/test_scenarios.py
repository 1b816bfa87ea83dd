"""The reference's integration scenarios as Spark jobs (match, mismatch,
resolve, retry, audit, idempotency)."""

import datetime as dt

from pyspark.sql import functions as F

from ledgermesh.config import AutoResolveConfig, MatchRules, RetryPolicy
from ledgermesh.operators import audit as A
from ledgermesh.operators import idempotency as IDM
from ledgermesh.operators import resolution as RS
from ledgermesh.operators import retry as RT
from ledgermesh.plans.batch import ReconTables, reconcile_batch

T0 = dt.datetime(2025, 1, 1)
ENV = ("idempotency_key string, transaction_ref string, source_system string, payload_text string, "
       "server_received_at timestamp_ntz")


def envelopes(spark, rows):
    return spark.createDataFrame(rows, ENV)


def payload(amount, currency="USD"):
    return '{"amount":"%s","currency":"%s"}' % (amount, currency)


def run(spark, rows, rules=MatchRules(abs_tolerance="0.01")):
    ing = IDM.ingest_batch(envelopes(spark, rows), T0)
    t = ReconTables.fresh(spark, ing.records)
    return reconcile_batch(t, rules, T0 + dt.timedelta(minutes=1), batch_id="b1")


def two_sources(a="100.00", b="200.00", ref="TX-1"):
    return [("k-a-" + ref, ref, "source_a", payload(a), T0), ("k-b-" + ref, ref, "source_b", payload(b),
                                                               T0 + dt.timedelta(seconds=5))]


def status(out, ref="TX-1"):
    return out.tables.state.filter(F.col("transaction_ref") == ref).first().status


def test_match(spark):
    assert status(run(spark, two_sources("100.00", "100.00"))) == "MATCHED"


def test_mismatch(spark):
    assert status(run(spark, two_sources())) == "MISMATCHED"


def test_auto_latest_and_priority(spark):
    out = run(spark, two_sources())
    t = out.tables
    refs = spark.createDataFrame([("TX-1",)], "transaction_ref string")
    res = RS.auto_resolve(refs, t.state, t.records, t.details, T0, strategy="latest_record")
    r = res.resolutions.first()
    assert r.chosen_source == "source_b" and res.state.first().status == "RESOLVED"
    res2 = RS.auto_resolve(refs, t.state, t.records, t.details, T0, strategy="source_priority",
                           cfg=AutoResolveConfig(source_priority="source_a,source_b"))
    assert res2.resolutions.first().chosen_source == "source_a"
    assert res2.audit_delta.first().event_type == "AUTO_RESOLUTION"


def test_manual_and_audit(spark):
    out = run(spark, two_sources())
    t = out.tables
    dec = spark.createDataFrame([("TX-1", "source_a", "tester")], "transaction_ref string, chosen_source string, resolver_id string")
    res = RS.resolve_manually(dec, t.state, T0 + dt.timedelta(minutes=2))
    assert res.state.first().status == "RESOLVED" and res.rejections.count() == 0
    audit = A.append_audit(t.audit, res.audit_delta)
    assert A.audit_counts(audit).first().entry_count == 2
    trail = A.audit_trail(audit).orderBy("ordinal").collect()
    assert [e.event_type for e in trail] == ["MATCH_ATTEMPT", "MANUAL_RESOLUTION"]
    assert A.replay_status(audit).first().replayed_status == "RESOLVED"


def test_manual_rejects_pending_and_unknown(spark):
    out = run(spark, two_sources("1.00", "1.00") + [("k-c", "TX-2", "source_a", payload("5.00"), T0)])
    dec = spark.createDataFrame([("TX-1", "a", "t"), ("TX-2", "a", "t"), ("TX-9", "a", "t"), ("", "a", "t")],
                                "transaction_ref string, chosen_source string, resolver_id string")
    rej = {r.transaction_ref: r.reason for r in RS.resolve_manually(dec, out.tables.state, T0).rejections.collect()}
    assert rej["TX-1"].startswith("invalid_status") and rej["TX-2"].startswith("invalid_status")
    assert rej["TX-9"].startswith("not_found") and rej[""].startswith("missing_field")


def test_retry_flow(spark):
    out = run(spark, two_sources())
    t = out.tables
    refs = spark.createDataFrame([("TX-1",)], "transaction_ref string")
    enq = RT.enqueue_retry(RT.empty_queue(spark), refs, t.state, T0, max_attempts=5)
    q = enq.queue.first()
    assert (q.status, q.attempt_count) == ("PENDING", 0)
    assert enq.audit_delta.first().event_type == "RETRY_ENQUEUED"
    # source_b re-sends the right amount, then the retry run re-matches
    fix = IDM.ingest_batch(envelopes(spark, [("k-b2", "TX-1", "source_b", payload("100.00"),
                                              T0 + dt.timedelta(minutes=2))]), T0).records
    t2 = ReconTables(t.records.unionByName(fix, allowMissingColumns=True), t.state, t.details,
                     A.append_audit(t.audit, enq.audit_delta))
    run_out = RT.run_retries(t2, enq.queue, MatchRules(abs_tolerance="0.01"), T0 + dt.timedelta(minutes=3),
                             RetryPolicy())
    assert run_out.queue.first().status == "RESOLVED"
    assert run_out.tables.state.first().status == "MATCHED"
    events = [r.event_type for r in run_out.tables.audit.collect()]
    assert "RETRY_ENQUEUED" in events and "RETRIGGER" in events and "RETRY_RESOLVED" in events


def test_retry_exhaustion_and_auto_apply(spark):
    out = run(spark, two_sources())
    t = out.tables
    q = spark.createDataFrame([("TX-1", 4, 5, None, T0, "PENDING", "api", T0, T0)], RT.QUEUE_SCHEMA)
    auto = AutoResolveConfig(auto_apply_on_exhaustion=True, default_strategy="first_submitted")
    r = RT.run_retries(t, q, MatchRules(abs_tolerance="0.01"), T0 + dt.timedelta(minutes=1), auto=auto)
    row = r.transitions.first()
    assert row.new_status == "EXHAUSTED" and row.new_attempt_count == 4  # D12
    assert r.queue.first().status == "RESOLVED"
    assert r.resolutions.first().resolver_id == "system:retry_worker"


def test_backoff_grows_and_caps(spark):
    from ledgermesh.functions.times import backoff_seconds
    df = spark.range(1, 9).select(backoff_seconds(F.col("id")).alias("b"))
    assert [r.b for r in df.collect()] == [60, 120, 240, 480, 960, 1920, 3600, 3600]


def test_idempotency_same_key_twice(spark):
    rows = [("k1", "TX-1", "a", payload("1.00"), T0), ("k1", "TX-1", "a", payload("1.00"), T0 + dt.timedelta(hours=1)),
            ("k1", "TX-1", "a", payload("1.00"), T0 + dt.timedelta(hours=30))]
    ing = IDM.ingest_batch(envelopes(spark, rows), T0 + dt.timedelta(days=2))
    labels = [r.idem_label for r in ing.labelled.orderBy("server_received_at").collect()]
    assert labels == ["stored", "duplicate", "ignored_after_ttl"]
    assert ing.records.count() == 1
    assert ing.labelled.select("stored_internal_id").distinct().count() == 1


def test_failed_key_can_be_resubmitted(spark):
    rows = [("k1", "TX-1", "a", payload("1,00"), T0), ("k1", "TX-1", "a", payload("1.00"), T0 + dt.timedelta(minutes=1))]
    ing = IDM.ingest_batch(envelopes(spark, rows), T0)
    labels = [r.idem_label for r in ing.labelled.orderBy("server_received_at").collect()]
    assert labels == ["failed", "stored"]
    assert ing.dlq.first().error_reason == "invalid_amount"


def test_incremental_due_refs_equal_full(spark):
    from ledgermesh.operators import state as S
    from ledgermesh.plans import fixtures as FX
    from ledgermesh.plans import scenarios as SC
    from conftest import SF
    p1, _ = SC.two_pass(spark, SF)
    recs = FX.f1_records(spark, SF)
    full = {r.transaction_ref for r in S.due_refs(recs, p1.tables.state, SC.PASS2_AS_OF).collect()}
    landed = recs.join(SC.pass1_records(recs).select("internal_id"), "internal_id", "left_anti")
    inc = {r.transaction_ref for r in S.due_refs(recs, p1.tables.state, SC.PASS2_AS_OF, landed=landed).collect()}
    assert full == inc and len(full) > 0


def test_late_landed_ref_is_due(spark):
    """Stamped long before the last run, landed after it: still due."""
    from ledgermesh.operators import state as S
    cols = "transaction_ref string, server_received_at timestamp_ntz"
    old = spark.createDataFrame([("A", T0)], cols)
    late = spark.createDataFrame([("B", T0 - dt.timedelta(days=900))], cols)
    state = spark.createDataFrame([("A", "MATCHED", 1, [], [], 1, 3, T0, T0, T0, T0)], S.STATE_SCHEMA)
    due = S.due_refs(old.unionByName(late), state, T0 + dt.timedelta(days=1), landed=late, pending_timeout_secs=60)
    assert [r.transaction_ref for r in due.collect()] == ["B"]


def test_hot_ref_is_collapsed_before_the_due_join(spark):
    from ledgermesh.plans.batch import ReconTables, reconcile_batch
    n = 3000  # one ref holds a third of the records
    recs = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("R"), (F.col("id") % 97).cast("string")))
        .alias("transaction_ref"),
        F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("source_system"),
        F.concat(F.lit("i"), F.col("id").cast("string")).alias("internal_id"),
        F.lit("1.00").alias("amount"), F.lit("USD").alias("currency"), F.lit(T0).cast("timestamp_ntz").alias("server_received_at"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = reconcile_batch(ReconTables.fresh(spark, recs), MatchRules(abs_tolerance="0.01"), T0)
        plan = out.decisions._jdf.queryExecution().optimizedPlan().toString()
        state = {r.transaction_ref: (r.status, r.record_count) for r in out.tables.state.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert state["HOT"] == ("MATCHED", n // 3)
    join = plan.index("LeftSemi")
    assert "max_by" in plan[join:]  # the collapse lies below the join


def test_idempotency_across_batches(spark):
    def batch(text, hours, existing=None):
        rows = [("k1", "TX-1", "a", payload(text), T0 + dt.timedelta(hours=hours))]
        return IDM.ingest_batch(envelopes(spark, rows), T0 + dt.timedelta(days=3), existing_keys=existing)
    first = batch("1.00", 0)
    for known in (first.records, IDM.idempotency_table(first.labelled)):
        got = [batch(text, h, known).labelled.first() for text, h in (("1,00", 1), ("1.00", 1), ("1.00", 30), ("1,00", 30))]
        assert [r.idem_label for r in got] == ["duplicate", "duplicate", "ignored_after_ttl", "failed"]
        assert {r.stored_internal_id for r in got} == {first.records.first().internal_id}


def test_identical_rows_and_rows_without_key(spark):
    rows = [("k1", "TX-1", "a", payload("1.00"), T0)] * 3 + [("", "TX-2", "a", payload("1.00"), T0)] * 2
    ing = IDM.ingest_batch(envelopes(spark, rows), T0)
    labels = sorted((r.idempotency_key, r.idem_label) for r in ing.labelled.collect())
    assert labels == [("", "failed")] * 2 + [("k1", "duplicate")] * 2 + [("k1", "stored")]


def test_upsert_plans_agree(spark):
    from ledgermesh.operators import state as S
    from ledgermesh.plans import scenarios as SC
    from conftest import SF
    p1, p2 = SC.two_pass(spark, SF)
    base = p1.tables.state
    delta = p2.decisions.filter("gate <> 'error'")
    a = S.upsert_state(base, delta, SC.PASS2_AS_OF).collect()
    b = S.upsert_state(base, delta, SC.PASS2_AS_OF, stored_base=True).collect()
    key = lambda r: r.transaction_ref
    assert sorted(a, key=key) == sorted(b, key=key)


def test_conflicting_duplicates(spark):
    rows = [("k1", "TX-1", "a", payload("1.00"), T0), ("k1", "TX-1", "a", payload("2.00"), T0),
            ("k2", "TX-2", "a", payload("1.00"), T0), ("k2", "TX-2", "a", payload("1.00"), T0),
            ("", "TX-3", "a", payload("1.00"), T0), ("", "TX-3", "a", payload("9.00"), T0)]
    out = IDM.conflicting_duplicates(envelopes(spark, rows)).collect()
    assert [(r.idempotency_key, r.distinct_payloads, r.submissions) for r in out] == [("k1", 2, 2)]
