"""The live limiter takes its rows in bounded micro-batches in order of time."""

import os
import random

from pyspark.sql import functions as F

from parapet.operators import limits
from parapet.plans import datasets as ds
from parapet.plans import registry


def test_live_limiter_takes_bounded_batches(spark, monkeypatch):
    rng, at, rows = random.Random(4), 1_704_067_200_000_000, []
    for i in range(600):
        at += rng.choice([0, 1_000_000, 15_000_000, 30_000_000, 400_000_000] + [8_000_000_000] * (i % 40 == 0))
        rows.append((i, at, rng.choice("abc")))
    rng.shuffle(rows)
    r = spark.createDataFrame(rows, "request_id long, at long, tenant_id string").select(
        "request_id", F.timestamp_micros("at").alias("ts"), "tenant_id")
    lim = spark.createDataFrame([("a", True, 2, 20), ("b", True, None, 9)],
                                "tenant_id string, enabled boolean, requests_per_minute int, requests_per_hour int")
    kept = []
    monkeypatch.setattr(registry, "LIVE_ROWS", 60, raising=False)
    monkeypatch.setattr(registry, "remove", lambda spark, *paths: kept.extend(paths))
    monkeypatch.setattr(ds, "traffic", lambda spark, sf: r)
    monkeypatch.setattr(ds, "limits", lambda spark: lim)
    got = {tuple(x) for x in registry.rate_limit_live(spark, "").collect()}
    want = {tuple(x) for x in limits.rate_limit(r, lim).select("request_id", "tenant_id", "limited", "reason", "retry_after").collect()}
    assert got == want and any(x[2] for x in want)
    source, state = next(p for p in kept if "live-in" in p), next(p for p in kept if "live-state" in p)
    files = spark.read.parquet(source).groupBy(F.input_file_name()).agg(F.count("*"), F.min("ts"), F.max("ts")).orderBy("min(ts)").collect()
    assert len(files) > 3 and max(f[1] for f in files) <= 90
    assert all(a[3] < b[2] for a, b in zip(files, files[1:]))
    assert len([f for f in os.listdir(f"{state}/commits") if f.isdigit()]) >= len(files)
