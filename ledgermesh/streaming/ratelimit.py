"""RL-1: per-source token-bucket replay as a stateful streaming operator.

Each source has a bucket of ``burst = max(1, int(10 * rps))`` tokens refilled
at ``rps`` tokens per second, full at first sight. A request takes one token
when at least one is available (``allowed``), otherwise it is ``denied`` and
takes none. The decision is a sequential recurrence per source, so it runs
where Spark keeps per-key state: ``applyInPandasWithState`` keyed by source.
Every call sees only one micro-batch's rows of one source (bounded by the
trigger size, e.g. ``maxFilesPerTrigger``/``maxBytesPerTrigger``) and carries
``(tokens, last_micros)`` to the next batch; a hot source is one key but never
more than one micro-batch of rows in memory. Within a batch rows are replayed
in ``(event time, request id)`` order; batches must arrive in time order per
source (time-partitioned landing, as with ``readStream`` over landed files).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

OUTPUT_SCHEMA = StructType([
    StructField("source_system", StringType()),
    StructField("request_id", StringType()),
    StructField("event_micros", LongType()),
    StructField("allowed", BooleanType()),
    StructField("tokens_after", DoubleType()),
])
STATE_SCHEMA = StructType([StructField("tokens", DoubleType()), StructField("last_micros", LongType())])


def burst_for(rps: float) -> int:
    return max(1, int(rps * 10))


def replay_bucket(times_micros: np.ndarray, rps: float, tokens: float | None, last: int | None):
    """Sequential token bucket over sorted times; returns (allowed, tokens_after, tokens, last)."""
    burst = float(burst_for(rps))
    n = len(times_micros)
    allowed = np.zeros(n, dtype=bool)
    after = np.zeros(n, dtype=float)
    if tokens is None:
        tokens, last = burst, None
    for i in range(n):
        t = int(times_micros[i])
        avail = burst if last is None else min(burst, tokens + max(0, t - last) / 1e6 * rps)
        if avail >= 1.0:
            tokens, last, allowed[i] = avail - 1.0, t, True
        # denied: the bucket is left as it was (no token, no refill bookkeeping)
        after[i] = tokens if allowed[i] else avail
    return allowed, after, tokens, last


def rate_limit_stream(requests: DataFrame, default_rps: float = 1000.0, overrides: dict | None = None,
                      time_col: str = "server_received_at", id_col: str = "request_id") -> DataFrame:
    """Label every request of a (streaming or batch) DataFrame allowed/denied.

    ``requests`` needs ``source_system``, ``time_col`` and ``id_col``.
    Use ``outputMode("append")`` on the returned streaming DataFrame.
    """
    overrides = dict(overrides or {})
    from pyspark.sql import functions as F
    rows = requests.select(F.col("source_system"), F.col(id_col).cast("string").alias("request_id"),
                           F.unix_micros(F.col(time_col).cast("timestamp")).alias("event_micros"))

    def step(key, pdfs, state):
        source = key[0]
        rps = float(overrides.get(source, default_rps))
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["event_micros", "request_id"])
        tokens, last = (state.get if state.exists else (None, None))
        allowed, after, tokens, last = replay_bucket(pdf["event_micros"].to_numpy(), rps, tokens, last)
        state.update((float(tokens), int(last) if last is not None else None))
        yield pd.DataFrame({"source_system": source, "request_id": pdf["request_id"].to_numpy(),
                            "event_micros": pdf["event_micros"].to_numpy(), "allowed": allowed,
                            "tokens_after": after})

    return rows.groupBy("source_system").applyInPandasWithState(
        step, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
