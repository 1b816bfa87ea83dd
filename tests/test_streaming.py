"""Streaming = batch: F3 events split by time into files, streamed through
incremental matching, must give the batch result; ingest stream writes
records and DLQ per epoch."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF
from ledgermesh.config import MatchRules
from ledgermesh.operators.matching import reconcile
from ledgermesh.plans import fixtures as FX
from ledgermesh.operators.matching import REF
from ledgermesh.plans.store import BucketTable
from ledgermesh.streaming import IngestTables, incremental_match, stream_ingest
from ledgermesh.streaming.jobs import EngineTables, records_with_status

AS_OF = dt.datetime(2025, 1, 1)


def three_parts(spark, d):
    """F3 in three files by time, with amounts that do not parse for some users of
    the second and repaired ones in the third."""
    recs = FX.f3_event_records(spark, SF).withColumn("amount", F.col("amount").cast("string"))
    cuts = [dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)]
    ts, user = F.col("server_received_at"), F.substring(REF, 3, 20).cast("int")
    parts = [recs.filter((ts < cuts[0]) & (user % 3 > 0)),
             recs.filter((ts >= cuts[0]) & (ts < cuts[1]) & (user % 3 > 0))
             .withColumn("amount", F.when(user % 5 == 0, "12,50").otherwise(F.col("amount"))),
             recs.filter((ts >= cuts[1]) | (user % 3 == 0))]
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("overwrite").parquet(f"{d}/landing/part{i}")
    return [spark.read.schema(recs.schema).parquet(f"{d}/landing/part{i}") for i in range(3)]


STATE = ("status", "retry_count", "record_count", "matched_sources", "mismatched_sources", "last_processed_at",
         "resolved_at", "created_at")
DETAILS = ("system_name", "internal_id", "amount", "discrepancy_found", "discrepancy_details", "processed_at")
AUDIT = ("event_type", "old_status", "new_status", "details", "created_at", "batch_id")


def rows(df, columns):
    return sorted((tuple(r[c] for c in (REF, *columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("timeout", [None, 20 * 24 * 3600])
def test_incremental_match_equals_batch_sequence(spark, timeout):
    """The stream over three files gives exactly the state, details, audit and
    record statuses of three batch runs over the cumulative records."""
    from ledgermesh.plans.batch import ReconTables, reconcile_batch
    d = tempfile.mkdtemp(prefix="lm-str-")
    parts = three_parts(spark, d)
    expected = ("click", "purchase") if timeout else ()
    rules = MatchRules(strategy="tolerance", abs_tolerance="50.00", expected_sources=expected, pending_timeout_secs=timeout)

    def as_of(epoch):
        return dt.datetime(2024, 1, 20) + dt.timedelta(days=epoch * 6)

    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/landing/*")
    q = incremental_match(stream, f"{d}/records", f"{d}/store", f"{d}/ckpt", rules, as_of_fn=as_of, buckets=8)
    q.awaitTermination(600)
    store = EngineTables(spark, f"{d}/store", 8)

    t = ReconTables.fresh(spark, parts[0].withColumn("status", F.lit("PENDING")))
    for i in range(3):
        if i:
            more = t.records.unionByName(parts[i].withColumn("status", F.lit("PENDING"))).checkpoint()
            t = ReconTables(more, t.state, t.details, t.audit)
        t = reconcile_batch(t, rules, as_of(i), materialize=True, batch_id=f"epoch-{i}").tables
        t = ReconTables(*[x.checkpoint() for x in (t.records, t.state, t.details, t.audit)])
    assert rows(store.state.read(), STATE) == rows(t.state, STATE) != []
    assert rows(store.details.read(), DETAILS) == rows(t.details, DETAILS) != []
    assert rows(store.audit(), AUDIT) == rows(t.audit, AUDIT)
    stored = records_with_status(store, store.records(f"{d}/records", ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in parts[0].schema)))
    statuses = rows(stored, ("internal_id", "status"))
    assert statuses == rows(t.records, ("internal_id", "status")) and {s for *_, s in statuses} > {"PENDING"}
    if timeout is None:  # decided refs kept their early decision (D9): their record_count is below the final count
        final = {r[REF]: r.n for r in t.records.groupBy(REF).agg(F.count("*").alias("n")).collect()}
        assert any(r[3] < final[r[0]] for r in rows(store.state.read(), STATE))
    else:  # the calendar kept only slots that may still be due
        assert any(r[1] == "MISMATCHED" for r in rows(store.state.read(), STATE))
        assert all(slot >= int(as_of(2).timestamp()) // 3600 for e, slot in store.due.parts(before=2))


def test_a_batch_reads_and_writes_the_buckets_of_its_refs(spark):
    d = tempfile.mkdtemp(prefix="lm-bk-")
    recs = FX.f3_event_records(spark, SF)
    recs.coalesce(1).write.parquet(f"{d}/in/p0")
    bucket = EngineTables(spark, f"{d}/store").state.bucket()
    used = sorted(r[0] for r in recs.select(bucket).distinct().collect())
    one, two, three = used[:3]
    few = recs.filter(bucket.isin(one, two)).withColumn("internal_id", F.concat("internal_id", F.lit("-late")))
    few = few.unionByName(recs.filter(bucket == three).withColumn(REF, F.lit("new ref")))
    few.coalesce(1).write.parquet(f"{d}/in/p1")
    new = few.filter(F.col(REF) == "new ref").select(bucket).first()[0]
    rules = MatchRules(strategy="tolerance", abs_tolerance="50.00", pending_timeout_secs=None)
    seen = []

    def go():
        stream = spark.readStream.schema(recs.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in/*")
        incremental_match(stream, f"{d}/records", f"{d}/store", f"{d}/ckpt", rules, as_of_fn=lambda e: AS_OF,
                          on_batch=lambda *x: seen.append(x)).awaitTermination(300)

    go()
    store = EngineTables(spark, f"{d}/store")
    assert seen[0] == (0, used, used) and len(used) > 3
    # late records of decided refs touch their buckets; only the new ref's is written
    assert seen[1] == (1, sorted({one, two, new}), [new])
    assert {x for x in store.state.parts() if x[0] == 1} == {(1, new)} == {x for x in store.details.parts() if x[0] == 1}
    files = store.state.read([one, two]).inputFiles()
    assert files and all(f"bucket={one}/" in f or f"bucket={two}/" in f for f in files)
    with pytest.raises(ValueError):
        EngineTables(spark, f"{d}/store", 32)


@pytest.mark.parametrize("fails_at", ["details", "state"])
def test_replay_after_a_crash(spark, monkeypatch, fails_at):
    """The second run of a batch that failed before its end leaves what one run
    leaves, also when a first batch had written the same buckets."""
    d = tempfile.mkdtemp(prefix="lm-crash-")
    recs = FX.f3_event_records(spark, SF)
    early = F.col("server_received_at") < dt.datetime(2024, 1, 15)
    recs.filter(early).coalesce(1).write.parquet(f"{d}/in/p0")
    recs.filter(~early).coalesce(1).write.parquet(f"{d}/in/p1")
    rules = MatchRules(strategy="tolerance", abs_tolerance="50.00", pending_timeout_secs=None)

    def go(to):
        stream = spark.readStream.schema(recs.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in/*")
        q = incremental_match(stream, f"{d}/{to}/records", f"{d}/{to}/store", f"{d}/{to}/ckpt", rules,
                              as_of_fn=lambda e: AS_OF + dt.timedelta(hours=e), reopen=True, buckets=8)
        q.awaitTermination(300)

    write = BucketTable.write

    def fail(self, df, epoch):
        if f"/{fails_at}/" in self.path and epoch == 1:
            if fails_at == "state":  # files of a lost attempt stay behind without Spark's _SUCCESS
                write(self, df, epoch)
                self._fs.delete(self._at("epoch=1/_SUCCESS"), False)
            raise RuntimeError("lost")
        write(self, df, epoch)

    go("whole")
    monkeypatch.setattr(BucketTable, "write", fail)
    with pytest.raises(Exception):
        go("crashed")
    monkeypatch.undo()
    go("crashed")
    whole, crashed = EngineTables(spark, f"{d}/whole/store", 8), EngineTables(spark, f"{d}/crashed/store", 8)
    assert rows(crashed.state.read(), STATE) == rows(whole.state.read(), STATE) != []
    assert rows(crashed.details.read(), DETAILS) == rows(whole.details.read(), DETAILS) != []
    assert rows(crashed.audit(), AUDIT) == rows(whole.audit(), AUDIT)


def land(df, path, condition=None):
    (df if condition is None else df.filter(condition)).coalesce(1).write.parquet(path)


def test_stream_ingest_equals_batch_labels(spark):
    """Re-sends within and after the TTL, in later files and after a restart, get the
    labels of one batch; records, DLQ and counters follow."""
    from ledgermesh.operators import idempotency as IDM
    d = tempfile.mkdtemp(prefix="lm-ing-")
    env = FX.f2_envelopes(spark, SF)
    k = F.col("row_id") % 10
    land(env, f"{d}/in/p0", (k == 0) | (F.col("row_id") % 38 == 1))  # some re-sends in the same file
    land(env, f"{d}/in/p1", (k == 1) & (F.col("row_id") % 38 != 1))

    def go(out):
        stream = spark.readStream.schema(env.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in/*")
        q = stream_ingest(stream, out, f"{d}/ckpt", as_of=AS_OF)
        q.awaitTermination(600)
        return q

    q = go(f"{d}/out")
    land(env, f"{d}/in/p2", k == 2)
    after = go(f"{d}/after")  # a restart; the records of the first run are elsewhere
    assert [s["description"].startswith("FileStreamSource") for s in after.lastProgress["sources"]] == [True]
    one, two = IngestTables(spark, f"{d}/out"), IngestTables(spark, f"{d}/after")
    lab = IDM.ingest_batch(env, AS_OF, checkpoint=True)
    columns = ("row_id", "idempotency_key", "idem_label", "stored_internal_id")
    pick = lambda df: sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    got = pick(one.submissions().select(*columns).unionByName(two.submissions().select(*columns)))
    assert got == pick(lab.labelled.filter("idempotency_key <> ''").unionByName(
        lab.labelled.filter("idempotency_key = ''"))) and {r[2] for r in got} == {"stored", "duplicate", "ignored_after_ttl", "failed"}

    names = [c for c in lab.records.columns if c != "tags"]
    same = lambda a, b: sorted(map(str, a.select(*names).collect())) == sorted(map(str, b.select(*names).collect()))
    assert same(one.records().unionByName(two.records()), lab.records)
    names = lab.dlq.columns
    assert same(one.dlq().unionByName(two.dlq()), lab.dlq)
    n = {r.idem_label: r["count"] for r in lab.labelled.groupBy("idem_label").count().collect()}
    sums = one.counters().unionByName(two.counters()).agg(*[F.sum(c).alias(c) for c in (
        "total_processed", "total_failed", "total_stored", "duplicate_hits", "ignored_after_ttl")]).first()
    summary = lab.summary().first()
    assert (sums.total_processed, sums.total_failed) == (summary.total_processed, summary.total_failed)
    assert (sums.total_stored, sums.duplicate_hits, sums.ignored_after_ttl) == (
        n["stored"], n["duplicate"], n["ignored_after_ttl"])
    keys = q.lastProgress["stateOperators"][0]["numRowsTotal"]  # a row per stored key, none for failures
    assert keys == one.records().count()


def test_stateful_stream_match_equals_batch(spark):
    """STR-2: re-decided on arrival, so state, details and audit equal batch runs
    over the refs of each file, also for records 91 days late."""
    from ledgermesh.operators import audit as A, state as S
    from ledgermesh.plans.batch import ReconTables, _run
    from ledgermesh.streaming.stateful import stream_match
    d = tempfile.mkdtemp(prefix="lm-sm-")
    recs = FX.f3_event_records(spark, SF).withColumn("amount", F.col("amount").cast("string"))
    user = F.substring(REF, 3, 20).cast("int")
    recs = recs.withColumn("amount", F.when((user % 7 == 0) & (F.col("source_system") == "purchase"), "1,5")
                           .otherwise(F.col("amount")))
    ts = F.col("server_received_at")
    late = (user % 2 == 0) & (F.col("source_system") == "click")
    recs = recs.withColumn("server_received_at", F.when(late, ts - F.expr("INTERVAL 91 DAYS")).otherwise(ts))
    parts = [recs.filter(~late & (ts < dt.datetime(2024, 1, 15))), recs.filter(~late & (ts >= dt.datetime(2024, 1, 15))),
             recs.filter(late)]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{d}/in/p{i}")
    rules = MatchRules(strategy="tolerance", abs_tolerance="50.00", pending_timeout_secs=None)
    stream = spark.readStream.schema(recs.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in/*")
    stream_match(stream, f"{d}/store", f"{d}/ck", rules, buckets=4).awaitTermination(600)
    store = EngineTables(spark, f"{d}/store", 4)

    t = ReconTables(recs.limit(0), S.empty_state(spark), S.empty_details(spark), A.empty_audit(spark))
    for i in range(3):
        part = spark.read.parquet(f"{d}/in/p{i}")
        refs = part.select(REF).distinct()
        records = t.records.unionByName(part).checkpoint()
        # a batch runs as of the latest record among the sources of its refs
        latest = records.join(refs, REF, "left_semi").agg(F.max("server_received_at")).first()[0]
        t = _run(ReconTables(records, t.state, t.details, t.audit), t.state, refs, rules, latest, f"epoch-{i}", 0, True).tables
        t = ReconTables(records, *[x.checkpoint() for x in (t.state, t.details, t.audit)])
    assert rows(store.state.read(), STATE) == rows(t.state, STATE) != []
    assert rows(store.details.read(), DETAILS) == rows(t.details, DETAILS) != []
    assert rows(store.audit(), AUDIT) == rows(t.audit, AUDIT)
    assert spark.read.parquet(f"{store.errors_dir}").count() > 0


def test_stateful_stream_match_times_out_and_stays_closed(spark):
    from ledgermesh.streaming.stateful import stream_match
    d = tempfile.mkdtemp(prefix="lm-sm2-")
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    schema = "transaction_ref string, source_system string, internal_id string, amount string, currency string, " \
             "server_received_at timestamp_ntz"
    files = [[("A", "erp", "a1", "1", "USD", day(0)), ("B", "erp", "b1", "1", "USD", day(1)), ("C", "erp", "c1", "1", "USD", day(9))],
             [("A", "bank", "a2", "1", "USD", day(8)), ("Z", "erp", "z", "1", "USD", day(30))],  # A's timer is overdue
             [("B", "bank", "b2", "1", "USD", day(31)), ("C", "bank", "c2", "1", "USD", day(9)), ("Z", "bank", "z2", "2", "USD", day(31))],
             [("A", "bank", "a3", "1", "USD", day(121))]]
    for i, f in enumerate(files):
        spark.createDataFrame(f, schema).coalesce(1).write.parquet(f"{d}/in/p{i}")
    rules = MatchRules(strategy="tolerance", abs_tolerance="0.50", expected_sources=("erp", "bank"),
                       pending_timeout_secs=3 * 24 * 3600)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in/*")
    stream_match(stream, f"{d}/store", f"{d}/ck", rules, buckets=4).awaitTermination(600)
    state = {r[REF]: (r.status, r.record_count) for r in EngineTables(spark, f"{d}/store", 4).state.read().collect()}
    # A and B missed a source when their timers fired; later records, also 91 days on, do not re-open them.
    # C's second record is late to arrive but was received in time
    assert state == {"A": ("MISMATCHED", 1), "B": ("MISMATCHED", 1), "C": ("MATCHED", 2), "Z": ("MISMATCHED", 2)}


def test_streamed_windows_equal_the_batch_queries(spark):
    """MON-1, MON-2 and MON-5 from a stream over three files, the second of which
    corrects windows of the first; a row behind the watermark is counted apart."""
    from ledgermesh.operators import idempotency as IDM, monitoring as MON
    from ledgermesh.streaming import windows as W
    d = tempfile.mkdtemp(prefix="lm-win-")
    lab = IDM.ingest_batch(FX.f2_envelopes(spark, SF), AS_OF, checkpoint=True).labelled.select(
        "row_id", "source_system", "idem_label", "server_received_at", F.octet_length("payload_text").alias("payload_bytes"))
    lab = lab.checkpoint()
    k = F.col("row_id") % 3
    for i in range(2):
        land(lab, f"{d}/in/p{i}", k == i)
    # the third file lifts the watermark past 1998; the fourth is behind it by years
    future = lab.limit(1).withColumn("server_received_at", F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz"))
    land(lab.filter(k == 2).unionByName(future), f"{d}/in/p2")

    def go():
        stream = spark.readStream.schema(lab.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in/*")
        W.stream_rates(stream, f"{d}/rates", f"{d}/ckpt", watermark="4000 days").awaitTermination(600)

    go()
    every = lab.unionByName(future)
    rates = W.rate_table(spark, f"{d}/rates").read()
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(MON.ingestion_rate(every), W.ingestion_rate(rates))
    assert same(MON.error_rate(every), W.error_rate(rates))
    assert same(MON.payload_size_histogram(every), W.payload_size_histogram(rates))
    assert {r.late for r in W.behind_watermark(every, rates).collect()} == {0}

    # after a restart with the watermark well past them, 7 old rows of one source change nothing
    old = lab.filter("source_system = 'erp_system'").limit(7).withColumn(
        "server_received_at", F.lit(dt.datetime(1990, 1, 1)).cast("timestamp_ntz")).checkpoint()
    land(old, f"{d}/in/p3")
    before = sorted(map(str, rates.collect()))
    go()
    rates = W.rate_table(spark, f"{d}/rates").read()
    assert sorted(map(str, rates.collect())) == before
    late = {r.source_system: r.late for r in W.behind_watermark(every.unionByName(old), rates).collect()}
    assert late.pop("erp_system") == 7 and set(late.values()) == {0}


def test_stale_decisions_as_a_stream_join(spark):
    """The refs of the stream join of decisions with the records that land later equal
    the batch query's; decisions without any come out once the horizon is over."""
    from ledgermesh.plans import scenarios as SC
    from ledgermesh.plans.catalog import QUERIES
    from ledgermesh.streaming.windows import late_records
    d = tempfile.mkdtemp(prefix="lm-stale-")
    p1, p2 = SC.two_pass(spark, SF)
    decided = p2.tables.audit.filter("new_status in ('MATCHED', 'MISMATCHED')").select(
        REF, F.col("new_status").alias("status"), F.col("created_at").cast("timestamp").alias("decided_at")).checkpoint()
    recs = FX.f1_records(spark, SF).select(REF, "internal_id", "source_system")
    hour = dt.timedelta(hours=1)
    at = lambda t: F.lit(t).cast("timestamp").alias("landed_at")
    first = SC.pass1_records(recs).select(REF, "internal_id", at(SC.PASS1_AS_OF - hour))
    second = SC.late_records(recs).select(REF, "internal_id", at(SC.PASS2_AS_OF - hour))
    end = SC.PASS2_AS_OF + dt.timedelta(days=40)
    for i, (dec, rec) in enumerate([(decided.filter(F.col("decided_at") == SC.PASS1_AS_OF), first),
                                    (decided.filter(F.col("decided_at") == SC.PASS2_AS_OF), second),
                                    (spark.createDataFrame([("end", "MATCHED", end)], decided.schema),
                                     spark.createDataFrame([("none", "x", end)], first.schema)),
                                    (spark.createDataFrame([("end2", "MATCHED", end + hour)], decided.schema),
                                     spark.createDataFrame([("none", "y", end + hour)], first.schema))]):
        land(dec, f"{d}/decisions/p{i}")
        land(rec, f"{d}/records/p{i}")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}/*")
    q = (late_records(read("decisions", decided.schema), read("records", first.schema)).writeStream.format("parquet")
         .option("path", f"{d}/out").option("checkpointLocation", f"{d}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(600)
    out = spark.read.parquet(f"{d}/out")
    stale = {r[REF] for r in out.filter("internal_id is not null").collect()}
    assert stale == {r[REF] for r in QUERIES["str04_stale_decisions"](spark, SF).collect()} != set()
    settled = {r[REF] for r in out.filter("internal_id is null").collect()}
    assert settled == {r[REF] for r in decided.collect()} - stale


def test_polling_source_reads_each_row_once(spark):
    """Three polls and a restart; equals the batch poll. Rows before ``since`` and rows
    without a time are not due."""
    from ledgermesh.sources.polling import register_polling
    register_polling(spark)
    d = tempfile.mkdtemp(prefix="lm-poll-")
    o = FX.table(spark, SF, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"),
                                             F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    o = o.unionByName(o.limit(3).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))).checkpoint()
    at = F.col("updated_at")
    times = sorted(r.updated_at for r in o.filter(at.isNotNull()).collect())
    since, *cuts = (times[k * len(times) // 4] for k in (0, 1, 2))
    assert since < cuts[0] < cuts[1] < times[-1]

    def go():
        stream = (spark.readStream.format("ledger_poll").option("path", f"{d}/table").option("since", since.isoformat())
                  .option("columns", "order_id,updated_at").load())
        assert stream.columns == ["order_id", "updated_at"]
        q = stream.writeStream.format("parquet").option("path", f"{d}/out").option(
            "checkpointLocation", f"{d}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination(300)

    o.filter((at < cuts[0]) | at.isNull()).repartition(2).write.mode("append").parquet(f"{d}/table")
    go()
    first = spark.read.parquet(f"{d}/out").count()
    o.filter((at >= cuts[0]) & (at < cuts[1])).repartition(2).write.mode("append").parquet(f"{d}/table")
    go()
    go()  # nothing new
    o.filter(at >= cuts[1]).repartition(2).write.mode("append").parquet(f"{d}/table")
    go()
    from ledgermesh.sources import read_incremental
    want, _ = read_incremental(o, "updated_at", since=since)
    got = spark.read.parquet(f"{d}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("order_id", "updated_at").collect()))
    assert 0 < first < got.count() < len(times)


def test_purge_drops_whole_days(spark):
    from ledgermesh.operators import idempotency as IDM
    d = tempfile.mkdtemp(prefix="lm-purge-")
    lab = IDM.ingest_batch(FX.f2_envelopes(spark, SF), AS_OF, checkpoint=True).labelled
    idem = IDM.idempotency_table(lab).checkpoint()
    IDM.write_keys(idem, f"{d}/keys")
    at = dt.datetime(1998, 1, 1, 12)
    files = lambda: {f for f in spark.read.parquet(f"{d}/keys").inputFiles()}
    before = files()
    gone = IDM.purge_expired_days(spark, f"{d}/keys", at)
    assert gone and gone[-1] < "1998-01-01" and files() < before  # no file was rewritten
    assert all("expires_on=" + f.split("expires_on=")[1][:10] not in {f"expires_on={g}" for g in gone} for f in files())
    pick = lambda df: sorted(r.idempotency_key for r in df.collect())
    assert pick(IDM.live_keys(spark, f"{d}/keys", at)) == pick(IDM.purge_expired(idem, at)) != []


def test_latency_sketches_merge_within_their_bound(spark):
    """Quantiles over any range of windows, from sketches kept per window, against exact ranks."""
    from ledgermesh.operators import monitoring as MON
    n, start = 40_000, dt.datetime(2024, 1, 1)
    k = F.col("id")
    latency = ((k * 7919) % 10_007).cast("long")
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 3600).cast("decimal(18,6)"))
    state = spark.range(n).select(F.concat(F.lit("r"), k).alias(REF), F.when(k % 4 > 0, "MATCHED").otherwise("MISMATCHED").alias("status"),
                                  at.alias("last_processed_at"), latency.alias("l"), k).checkpoint()
    recs = state.select(REF, (F.col("last_processed_at") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("l").cast("decimal(18,6)")))
                        .alias("server_received_at"))
    sketches = MON.latency_sketches(state, recs).checkpoint()
    assert sketches.count() == 2 * 60
    for since, until in ((None, None), (start + dt.timedelta(minutes=7), start + dt.timedelta(minutes=31))):
        inside = state if since is None else state.filter((F.col("last_processed_at") >= F.lit(since)) & (F.col("last_processed_at") < F.lit(until)))
        exact = {}
        for r in inside.select("status", "l").collect():
            exact.setdefault(r.status, []).append(r.l)
        for r in MON.latency_quantiles(sketches, since, until).collect():
            values = sorted(exact[r.status])
            assert r.refs == len(values)
            for q, got in ((0.5, r.p50_s), (0.95, r.p95_s)):
                below, upto = sum(v < got for v in values), sum(v <= got for v in values)
                assert below - 0.02 * len(values) <= q * len(values) <= upto + 0.02 * len(values)
