"""Audit analytics, billing plans, and the shape of physical plans."""

from pyspark.sql import functions as F

from parapet.operators import audit, policy
from parapet.operators.limits import rate_limit
from parapet.operators.scan import lookup, running
from tests.helpers import message_frame

def at():
    return F.lit("2024-01-10 00:00:00").cast("timestamp")


def log(spark):
    rows = [(1, "2024-01-09 10:00:00", "a", "openai", "passed", None, 5, 7), (2, "2024-01-09 11:00:00", "a", "anthropic", "passed", None, None, None),
            (3, "2024-01-01 10:00:00", "a", "openai", "passed", None, 100, 100), (4, "2024-01-09 10:00:00", "b", "openai", "input_blocked", "r1", None, None),
            (5, "2024-01-09 10:30:00", "b", "openai", "rate_limited", "r2", None, None), (6, "2023-12-31 23:59:59", "b", "openai", "passed", None, 1, 1)]
    return spark.createDataFrame(rows, "id long, ts string, tenant_id string, api string, outcome string, reason string, prompt_tokens long, completion_tokens long"
                                 ).withColumn("ts", F.col("ts").cast("timestamp"))


def test_stats_and_empty(spark):
    assert tuple(audit.audit_stats(log(spark)).first()) == (6, 2, 66.7)
    assert tuple(audit.audit_stats(log(spark), "b", scoped="nobody").first()) == (0, 0, 100.0)
    assert [tuple(r) for r in audit.top_block_reasons(log(spark), 1).collect()] == [("r1", 1)]


def test_tokens(spark):
    got = {r.tenant_id: r for r in audit.token_metrics(log(spark), at(), 7).collect()}
    assert got["a"].total_tokens == 12 and got["a"].by_api["anthropic"].input_tokens == 0 and got["b"].total_tokens == 0
    levels = {(r.tenant_id, r.api, r.level): r.requests for r in audit.token_metrics_rollup(log(spark), at(), 7).collect()}
    assert levels[None, None, 3] == 4 and levels["a", None, 1] == 2


def test_month_recent_usage_sessions(spark):
    got = {(r.tenant_id, r.month.strftime("%Y-%m")): r.passed_requests for r in audit.monthly_usage(log(spark)).collect()}
    assert got == {("a", "2024-01"): 3, ("b", "2023-12"): 1}
    assert [r.id for r in audit.recent_audit(log(spark), 2, "a").collect()] == [3, 2]
    accounts = spark.createDataFrame([("a", "starter"), ("x", "odd")], "tenant_id string, plan string")
    use = {r.tenant_id: r for r in audit.account_usage(log(spark), accounts, policy.plans_table(spark), at()).collect()}
    assert (use["a"].monthly_used, use["a"].monthly_requests, use["x"].monthly_requests, use["x"].pass_rate) == (3, 100000, 200, 100.0)
    assert sorted((r.tenant_id, r.requests) for r in audit.tenant_sessions(log(spark), 3600).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_billing(spark):
    rows = [(1, "checkout.session.completed", "u", "starter", "c", None, None), (2, "invoice.payment_failed", None, None, "c", "open", 2),
            (3, "customer.subscription.updated", None, None, "c", "active", None), (4, "checkout.session.completed", "u", "growth", "c", None, None),
            (5, "checkout.session.completed", "u", "gold", "c", None, None), (6, "customer.subscription.updated", None, None, "c", "past_due", None),
            (7, "customer.subscription.paused", None, None, "c", None, None), (8, "invoice.payment_failed", None, None, "other", "open", 3)]
    ev = spark.createDataFrame(rows, "d int, type string, user_id string, plan string, customer string, status string, attempt_count int").withColumn(
        "ts", F.timestamp_micros((F.lit(1_704_067_200) + F.col("d").cast("long") * 40 * 86400) * 1_000_000))
    accounts = spark.createDataFrame([("u", "c")], "user_id string, customer string")
    hist = policy.plan_history(ev, accounts).orderBy("valid_from").collect()
    assert [r.plan for r in hist] == ["starter", "growth", "free"] and hist[-1].valid_to is None and hist[0].valid_to == hist[1].valid_from
    now = policy.effective_limits(policy.plan_history(ev, accounts), policy.plans_table(spark), F.lit("2026-01-01").cast("timestamp")).collect()
    assert [(r.plan, r.requests_per_minute) for r in now] == [("free", 10)]


def test_running_values_over_blocks(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = running(d, ["k"], ["id"], F.floor(F.col("id") / 10), sums={"total": F.col("v")}, maxes={"top": F.col("v")}).collect()
    for k in range(3):
        total = top = 0
        for r in sorted((r for r in got if r.k == k), key=lambda r: r.id):
            total, top = total + r.v, max(top, r.v)
            assert (r.total, r.top) == (total, top)


def test_large_lookup_is_salted(spark, monkeypatch):
    from parapet.operators import scan
    monkeypatch.setattr(scan, "BROADCAST_BYTES", 0)
    facts = spark.range(1000).select("id", F.lit("hot").alias("k"))
    table = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    assert lookup(facts, table, ["k"]).where("v = 1").count() == 1000


def plan_of(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark).withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(path)
    p = plan_of(audit.token_metrics_by_api(spark.read.parquet(path), at(), 7, "a"))
    scan_line = next(line for line in p.splitlines() if "FileScan" in line)
    assert "EqualTo(tenant_id,a)" in scan_line and "reason" not in scan_line and "Cartesian" not in p and "NestedLoop" not in p
    r = spark.createDataFrame([(1, "2024-01-01", "a")], "request_id long, ts string, tenant_id string").withColumn("ts", F.col("ts").cast("timestamp"))
    lim = spark.createDataFrame([("a", True, 1, 2)], "tenant_id string, enabled boolean, requests_per_minute int, requests_per_hour int")
    assert "NestedLoop" not in plan_of(rate_limit(r, lim))


def test_audit_rows_hold_messages(spark):
    m = message_frame(spark, [(1, "t", 1, "assistant", ["b"]), (1, "t", 0, "user", ["mail a@x.org"]), (2, "t", 0, "user", [None, "c"])])
    o = spark.createDataFrame([(1, "passed"), (2, "passed"), (3, "rate_limited")], "request_id long, outcome string")
    got = {r["request_id"]: r["messages"] for r in audit.with_messages(o, m).collect()}
    assert [tuple(x) for x in got[1]] == [("user", "mail a@x.org"), ("assistant", "b")]
    assert [x["text"] for x in got[2]] == ["c"] and got[3] is None
    clean = {r["request_id"]: r["messages"] for r in audit.with_messages(o, m, redact=True).collect()}
    assert clean[1][0]["text"] == "mail [REDACTED_EMAIL]"
