import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from parapet.operators import limits
from parapet.operators.limits import Leaps, Limiter, rate_limit

START = 1_704_067_200_000_000


def model(times, rpm, rph):
    """Decisions from the definition: count allowed requests in each window."""
    allowed, out = [], []
    for now in times:
        verdict = None
        for width, limit, label in ((60_000_000, rpm, "minute"), (3_600_000_000, rph, "hour")):
            seen = [t for t in allowed if t >= now - width]
            if limit is not None and len(seen) >= limit:
                wait = max(1, (seen[0] + width - now) // 1_000_000 + 1) if seen else width // 1_000_000
                verdict = (f"Rate limit exceeded: {limit} requests per {label}", wait)
                break
        if verdict is None:
            allowed.append(now)
        out.append(verdict)
    return out


def logs(seed):
    rng = random.Random(seed)
    config = {"a": (3, 20), "b": (2, None), "c": (None, 5), "d": (0, 4), "e": (50, 5000), "hot": (4, 30)}
    rows, i = [], 0
    for tenant in config:
        now, n = START, 1500 if tenant == "hot" else 250
        for _ in range(n):
            now += rng.choice([0, 1, 5_000_000, 10_000_000, 20_000_000, 60_000_000, 60_000_001, 400_000_000]
                              + ([3_600_000_000, 3_700_000_000] if rng.random() < .1 else []))
            rows.append((i, now, tenant))
            i += 1
    return rows, config


def frames(spark, rows, config):
    r = spark.createDataFrame(rows, "request_id long, at long, tenant_id string").withColumn("ts", F.timestamp_micros("at"))
    lim = spark.createDataFrame([(t, True, m, h) for t, (m, h) in config.items()] + [("off", False, 1, 1)],
                                "tenant_id string, enabled boolean, requests_per_minute int, requests_per_hour int")
    return r, lim


def check(spark, seed, **kw):
    rows, config = logs(seed)
    r, lim = frames(spark, rows, config)
    got = {x.request_id: (x.reason, x.retry_after) if x.limited else None for x in limits.rate_limit(r, lim, **kw).collect()}
    assert len(got) == len(rows)
    for tenant, (m, h) in config.items():
        mine = sorted((at, i) for i, at, t in rows if t == tenant)
        want = model([at for at, _ in mine], m, h)
        assert [got[i] for _, i in mine] == want, tenant


def test_limiter_equals_model(spark):
    check(spark, 1)


def test_limiter_in_slices_equals_model(spark):
    """A busy key cut into several slices, with its state carried over."""
    check(spark, 2, rows_per_slice=400)


def test_few_requests_and_disabled(spark):
    rows = [(i, START + i, "a") for i in range(4)] + [(9, START, "off"), (10, START, "unknown")]
    r, lim = frames(spark, rows, {"a": (3, None)})
    got = {x.request_id: x.limited for x in limits.rate_limit(r, lim).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 9: False, 10: False}


def test_status(spark):
    rows = [(1, START, "a"), (2, START + 30_000_000, "a"), (3, START + 3_000_000_000, "a")]
    r, lim = frames(spark, rows, {"a": (3, 20)})
    d = limits.rate_limit(r, lim)
    at = F.timestamp_micros(F.lit(START + 3_001_000_000))
    got = {x.window: (x.used, x.remaining) for x in limits.rate_limit_status(d, lim, at).collect()}
    assert got == {"minute": (1, 2), "hour": (3, 17)}


def test_request_rate(spark):
    rows = [(i, START + i * 20_000_000, "a") for i in range(10)]
    r, _ = frames(spark, rows, {"a": (1, 1)})
    got = {x.request_id: x.rate for x in limits.request_rate(r, 60).collect()}
    assert got == {i: min(i, 3) + 1 for i in range(10)}


def test_monthly_cap(spark):
    plans = spark.createDataFrame([("free", 0, 3, 1, 1), ("big", 0, 100000, 1, 1)],
                                  "plan string, price_monthly int, monthly_requests long, rpm int, rph int")
    accounts = spark.createDataFrame([("a", "free"), ("b", "big"), ("c", "gone")], "tenant_id string, plan string")
    rows = [(t * 1000 + i, START + i * 7_000_000 + (i // 40) * 31 * 86_400_000_000, "abcd"[t], i % 3 != 0) for t in range(4) for i in range(80)]
    r = spark.createDataFrame(rows, "request_id long, at long, tenant_id string, would_pass boolean").withColumn("ts", F.timestamp_micros("at"))
    got = {x.request_id: (x.capped, x.reason) for x in limits.monthly_cap(r, accounts, plans).collect()}
    used = {}
    for i, at, t, ok in sorted(rows, key=lambda x: (x[1], x[0])):
        month = dt.datetime.fromtimestamp(at / 1e6, dt.timezone.utc).strftime("%Y%m")
        cap = {"a": 3, "b": 100000, "c": 3}.get(t)
        want = cap is not None and used.get((t, month), 0) >= cap
        assert got[i][0] == want
        used[t, month] = used.get((t, month), 0) + ok
    assert {v[1] for k, v in got.items() if v[0]} == {"Monthly request limit reached (3 requests). Upgrade your plan to continue."}


def test_leaps_equal_one_by_one_decisions():
    rng = random.Random(11)
    for case in range(300):
        rpm, rph = rng.choice([None, 0, 1, 2, 5]), rng.choice([None, 0, 1, 3, 8])
        at, times = 1_700_000_000_000_000, []
        for _ in range(rng.randrange(0, 120)):
            at += rng.choice([0, 0, 1_000_000, 20_000_000, 60_000_000, 60_000_001, 900_000_000, 3_600_000_000])
            times.append(at)
        plain, leaps = Limiter(rpm, rph), Leaps(rpm, rph)
        want = [plain.decide(t) for t in times]
        got, cut = [], rng.randrange(0, len(times) + 1)
        for part in (times[:cut], times[cut:]):
            part = np.array(part, dtype=np.int64)
            by, oldest = leaps.decide(part)
            for t, w, o in zip(part.tolist(), by.tolist(), oldest.tolist()):
                if w < 0:
                    got.append((None, None))
                    continue
                width, limit, label = leaps.windows[w]
                wait = width // 1_000_000 if limit == 0 else max(1, (o + width - t) // 1_000_000 + 1)
                got.append((f"Rate limit exceeded: {limit} requests per {label}", wait))
        assert got == want, (case, rpm, rph)


def test_a_key_that_is_always_over_its_limit(spark):
    n = 200_000
    r = spark.range(n).select(F.col("id").alias("request_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 7_000).alias("ts"),
                              F.lit("hot").alias("tenant_id"))
    lim = spark.createDataFrame([("hot", True, 5, 60)], "tenant_id string, enabled boolean, requests_per_minute int, requests_per_hour int")
    got = rate_limit(r, lim, rows_per_slice=30_000)
    allowed = sorted(x[0] for x in got.where("NOT limited").select("request_id").collect())
    plain = Limiter(5, 60)
    assert allowed == [i for i in range(n) if plain.decide(1_704_067_200_000_000 + i * 7_000)[0] is None] and got.count() == n
