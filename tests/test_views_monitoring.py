"""Listing and monitoring helpers not covered by a registered query."""

from pyspark.sql import functions as F

from conftest import SF
from ledgermesh.operators import monitoring as MON
from ledgermesh.operators import resolution as RS
from ledgermesh.operators import views as V
from ledgermesh.plans import fixtures as FX
from ledgermesh.plans import scenarios as SC


def test_latest_records_of_one_source(spark):
    recs = FX.f1_records(spark, SF)
    got = [r.internal_id for r in V.latest_records_of_source(recs, "payment_gateway", 3).collect()]
    want = [r.internal_id for r in recs.filter(F.col("source_system") == "payment_gateway")
            .orderBy(F.col("server_received_at").desc(), F.col("internal_id").desc()).limit(3).collect()]
    assert got == want and len(got) == 3


def test_auto_resolutions_per_minute_and_page_token(spark):
    t = SC.f4_tables(spark, SF)
    refs = t.state.filter(SC.order_key() % 5 == 0).select("transaction_ref")
    res = RS.auto_resolve(refs, t.state, t.records, t.details, SC.F4_AS_OF, strategy="latest")
    per_min = MON.auto_resolutions_per_minute(res.resolutions).collect()
    assert sum(r.resolutions for r in per_min) == res.resolutions.count()
    assert {(r.strategy, r.outcome) for r in per_min} == {("latest_record", "success")}
    page = V.list_mismatches(t.state, t.details, size=500)  # over the maximum: default size 20 (D15)
    assert page.count() == 20
    token = V.next_page_token(page).first().next_page_token
    nxt = V.list_mismatches(t.state, t.details, size=20, after=token).first().transaction_ref
    assert nxt > token


def test_exact_latency_and_rate_width(spark):
    from pyspark.sql import functions as F
    n = 5001
    state = spark.range(n).select(F.concat(F.lit("r"), "id").alias("transaction_ref"), F.lit("MATCHED").alias("status"),
                                  (F.timestamp_seconds(F.lit(10**6) + F.col("id") * 97)).cast("timestamp_ntz").alias("last_processed_at"))
    records = spark.range(n).select(F.concat(F.lit("r"), "id").alias("transaction_ref"),
                                    F.timestamp_seconds(F.lit(10**6)).cast("timestamp_ntz").alias("server_received_at"))
    r = MON.decision_latency(state, records).first()
    assert (r.p50_s, r.p95_s, r.refs) == (2500 * 97, 4750 * 97, n)  # ranks 2501 and 4751
    lab = spark.range(300).select(F.lit("erp").alias("source_system"), F.lit("stored").alias("idem_label"),
                                  F.timestamp_seconds(F.lit(600) + F.col("id") % 300).cast("timestamp_ntz").alias("server_received_at"))
    assert [x.per_second for x in MON.ingestion_rate(lab, width="5 minutes").collect()] == [1.0]


def test_write_records_keeps_one_row_per_key(spark):
    from ledgermesh.operators.idempotency import write_records
    base = spark.createDataFrame([("a", "k1")], "internal_id string, idempotency_key string")
    new = spark.createDataFrame([("b", "k1"), ("c", "k2"), ("d", "k2"), ("c", "k2")], base.schema)
    assert sorted(map(tuple, write_records(base, new).collect())) == [("a", "k1"), ("c", "k2")]


def test_pages_of_a_written_listing(spark, tmp_path):
    """Paging and lookups read one chunk of many and equal the pages of the views."""
    from ledgermesh.operators import pages as PG, retry as RT, views as V
    from ledgermesh.plans import scenarios as SC
    from conftest import SF
    t = SC.f4_tables(spark, SF)
    mismatched = t.state.filter("status = 'MISMATCHED'").checkpoint()
    PG.write_listing(mismatched, str(tmp_path / "m"), ["transaction_ref"], rows_per_chunk=25)
    total = len(set(spark.read.parquet(str(tmp_path / "m" / "rows")).inputFiles()))
    assert total > 8
    after, seen = None, []
    while True:
        page = PG.read_page(spark, str(tmp_path / "m"), 20, after and {"transaction_ref": after})
        want = V.list_mismatches(t.state, t.details, size=20, after=after)
        rows = [r.transaction_ref for r in page.collect()]
        assert rows == [r.transaction_ref for r in want.collect()]
        if not rows:
            break
        assert len(page.inputFiles()) <= 3 < total
        seen += rows
        after = rows[-1]
    assert len(seen) == mismatched.count()
    some = PG.look_up(spark, str(tmp_path / "m"), [{"transaction_ref": r} for r in (seen[3], seen[-2], "none")])
    assert sorted(r.transaction_ref for r in some.collect()) == sorted([seen[3], seen[-2]]) and len(some.inputFiles()) <= 4
    assert PG.look_up(spark, str(tmp_path / "m"), []).count() == 0

    queue = SC.f4_queue(t.state).filter("status = 'PENDING'").checkpoint()  # many equal times: ties go by the ref
    PG.write_listing(queue, str(tmp_path / "q"), ["next_retry_at", "transaction_ref"], rows_per_chunk=25)
    after = None
    for _ in range(4):
        key = after and {"next_retry_at": after[0], "transaction_ref": after[1]}
        got = [(r.next_retry_at, r.transaction_ref) for r in PG.read_page(spark, str(tmp_path / "q"), 30, key).collect()]
        assert got == [(r.next_retry_at, r.transaction_ref) for r in RT.queue_page(queue, 30, after, "PENDING").collect()] != []
        after = got[-1]
    PG.write_listing(queue.limit(0), str(tmp_path / "e"), ["transaction_ref"])
    assert PG.read_page(spark, str(tmp_path / "e"), 5).count() == 0
