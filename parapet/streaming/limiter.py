"""The sliding-window limiter on a live request stream."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from parapet.operators.limits import HOUR, Limiter, _limits
from parapet.operators.scan import lookup

OUT = "tenant_id string, request_id string, ts timestamp, limited boolean, reason string, retry_after int, late boolean"
STATE = "latest long, times array<bigint>"


def _advance(key, batches, state):
    if state.hasTimedOut:
        # a full hour without traffic: nothing recorded can still matter
        state.remove()
        return
    pdf = pd.concat(list(batches)).sort_values(["at", "request_id"])
    latest, times = state.get if state.exists else (0, [])
    first = pdf.iloc[0]
    limiter = Limiter(*[None if pd.isna(v) else int(v) for v in (first.rpm, first.rph)])
    for t in times:
        limiter.record(t)
    rows = []
    for at, request_id, ts in zip(pdf["at"].tolist(), pdf["request_id"].tolist(), pdf["ts"].tolist()):
        # arrival order rules: a late row is decided at the latest time seen
        now = max(at, latest)
        reason, wait = limiter.decide(now)
        rows.append((key[0], request_id, ts, reason is not None, reason, wait, at < latest))
        latest = now
    state.update((latest, limiter.times()))
    state.setTimeoutTimestamp(max(latest + HOUR, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1)
    out = pd.DataFrame(rows, columns=["tenant_id", "request_id", "ts", "limited", "reason", "retry_after", "late"])
    yield out.astype({"retry_after": "Int32"})


def rate_limit_stream(requests: DataFrame, limits: DataFrame, delay: str = "1 minute",
                      keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Decisions for a stream of (request_id, ts, tenant_id), in append mode.

    State per tenant is the allowed times of the last hour, at most as many as the
    larger limit, and goes away after an idle hour of event time.  A tenant's
    micro-batch is bounded by the source's rate settings.  More ``keys`` after the
    tenant cut its requests into stretches that do not touch each other.
    """
    d = requests.select(F.col("request_id").cast("string").alias("request_id"), "ts", *keys)
    d = lookup(d.withWatermark("ts", delay), _limits(limits), ["tenant_id"])
    d = d.withColumn("at", F.unix_micros("ts"))
    return d.groupBy(*keys).applyInPandasWithState(
        _advance, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
