"""RL-1 streaming replay against a brute-force token bucket over the events table."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF
from ledgermesh.operators.monitoring import rate_limited_by_source
from ledgermesh.plans.fixtures import table
from ledgermesh.streaming.ratelimit import burst_for, rate_limit_stream


def brute_force(rows, rps_of):
    state, out = {}, {}
    for src, rid, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        rps = rps_of(src)
        burst = float(burst_for(rps))
        tokens, last = state.get(src, (burst, None))
        avail = burst if last is None else min(burst, tokens + max(0, t - last) / 1e6 * rps)
        if avail >= 1.0:
            state[src] = (avail - 1.0, t)
            out[rid] = True
        else:
            out[rid] = False
    return out


def test_rate_limit_stream_matches_brute_force(spark):
    d = tempfile.mkdtemp(prefix="lm-rl-")
    ev = table(spark, SF, "events").select(
        F.col("event_type").alias("source_system"), F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").alias("server_received_at"))
    # land in time order as several files so the state carries across micro-batches
    cut = ev.agg(F.expr("percentile_approx(unix_micros(cast(server_received_at as timestamp)), 0.5)")).first()[0]
    early = ev.filter(F.unix_micros(F.col("server_received_at").cast("timestamp")) <= cut)
    late = ev.filter(F.unix_micros(F.col("server_received_at").cast("timestamp")) > cut)
    early.coalesce(1).write.parquet(f"{d}/in/p0")
    late.coalesce(1).write.parquet(f"{d}/in/p1")
    overrides = {"click": 0.0005, "view": 0.002}
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in/*")
    labels = rate_limit_stream(stream, default_rps=0.001, overrides=overrides)
    q = (labels.writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/ck")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = {r.request_id: r.allowed for r in spark.read.parquet(f"{d}/out").collect()}
    rows = [(r.source_system, r.request_id, r.t) for r in ev.select(
        "source_system", "request_id",
        F.unix_micros(F.col("server_received_at").cast("timestamp")).alias("t")).collect()]
    want = brute_force(rows, lambda s: overrides.get(s, 0.001))
    assert got == want
    assert 0 < sum(not v for v in got.values()) < len(got)
    mon = {r.source_system: r.rate_limited for r in rate_limited_by_source(spark.read.parquet(f"{d}/out")).collect()}
    assert sum(mon.values()) == sum(not v for v in want.values())
