"""Analytics over the audit log.  Every aggregate combines on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions import pii
from parapet.functions.text import map_text, message_text
from parapet.operators.policy import account_plans
from parapet.operators.scan import lookup


def audit_filter(log: DataFrame, tenant: str | None = None, api: str | None = None,
                 scoped: str | None = None) -> DataFrame:
    """Rows of a tenant and an api; a session's own tenant wins over the asked one."""
    chosen = scoped or tenant
    if chosen:
        log = log.where(F.col("tenant_id") == chosen)
    if api:
        log = log.where(F.col("api") == api)
    return log


def _stats() -> list[Column]:
    total, blocked = F.count("*"), F.count_if(F.col("outcome") != "passed")
    rate = F.when(total > 0, F.round((total - blocked) / total * 100, 1)).otherwise(100.0)
    return [total.alias("total_requests"), blocked.alias("blocked_requests"), rate.alias("pass_rate")]


def audit_stats(log: DataFrame, tenant: str | None = None, scoped: str | None = None) -> DataFrame:
    return audit_filter(log, tenant, scoped=scoped).agg(*_stats())


def audit_stats_by_tenant(log: DataFrame) -> DataFrame:
    return log.groupBy("tenant_id").agg(*_stats())


def top_block_reasons(log: DataFrame, n: int = 5, tenant: str | None = None, group_by: str = "reason",
                      scoped: str | None = None) -> DataFrame:
    """Most frequent reasons among rows that did not pass; ties in text order."""
    blocked = audit_filter(log, tenant, scoped=scoped).where(F.col("outcome") != "passed")
    counts = blocked.groupBy(group_by).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(group_by)).limit(n)


def _tokens() -> list[Column]:
    return [F.count("*").alias("requests"),
            F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("output_tokens")]


def _recent(log: DataFrame, as_of: Column, days: int, tenant: str | None, scoped: str | None) -> DataFrame:
    return audit_filter(log, tenant, scoped=scoped).where(
        F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))


def token_metrics_by_api(log: DataFrame, as_of: Column, days: int = 7, tenant: str | None = None,
                         scoped: str | None = None) -> DataFrame:
    return (_recent(log, as_of, days, tenant, scoped).groupBy("tenant_id", "api").agg(*_tokens())
            .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")))


def token_metrics(log: DataFrame, as_of: Column, days: int = 7, tenant: str | None = None,
                  scoped: str | None = None) -> DataFrame:
    """Sums per tenant with a nested map by api (a handful of entries)."""
    per_api = token_metrics_by_api(log, as_of, days, tenant, scoped)
    entry = F.struct("api", F.struct("requests", "input_tokens", "output_tokens").alias("value"))
    return per_api.groupBy("tenant_id").agg(
        F.sum("requests").alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_api"))


def token_metrics_rollup(log: DataFrame, as_of: Column, days: int = 7, tenant: str | None = None,
                         scoped: str | None = None) -> DataFrame:
    """Per api, per tenant and overall in one pass; ``level`` 0, 1 and 3."""
    per_api = token_metrics_by_api(log, as_of, days, tenant, scoped)
    return per_api.rollup("tenant_id", "api").agg(
        F.grouping_id().alias("level"), F.sum("requests").alias("requests"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"))


def monthly_usage(log: DataFrame, month: Column | None = None) -> DataFrame:
    """Passed requests per tenant and calendar month (UTC)."""
    passed = log.where(F.col("outcome") == "passed")
    if month is not None:
        first = F.date_trunc("month", month)
        passed = passed.where((F.col("ts") >= first) & (F.col("ts") < F.add_months(first, 1)))
    return passed.groupBy("tenant_id", F.date_trunc("month", "ts").alias("month")).agg(
        F.count("*").alias("passed_requests"))


def recent_audit(log: DataFrame, limit: int = 50, tenant: str | None = None, api: str | None = None,
                 scoped: str | None = None) -> DataFrame:
    """Newest entries first; a top-n, never a full sort."""
    return audit_filter(log, tenant, api, scoped).orderBy(F.desc("id")).limit(limit)


def account_usage(log: DataFrame, accounts: DataFrame, plans: DataFrame, as_of: Column) -> DataFrame:
    """Totals, pass rate, this month's passed count and plan of every account."""
    stats = audit_stats_by_tenant(log)
    month = monthly_usage(log, as_of).select("tenant_id", F.col("passed_requests").alias("monthly_used"))
    d = lookup(accounts.select("tenant_id", "plan"), stats, ["tenant_id"])
    d = lookup(d, month, ["tenant_id"])
    d = account_plans(d, plans)
    return d.select(
        "tenant_id", "plan", F.coalesce("total_requests", F.lit(0)).alias("total_requests"),
        F.coalesce("blocked_requests", F.lit(0)).alias("blocked_requests"),
        F.coalesce("pass_rate", F.lit(100.0)).alias("pass_rate"),
        F.coalesce("monthly_used", F.lit(0)).alias("monthly_used"), "monthly_requests", "price_monthly")


def audit_by_minute(log: DataFrame, width: str = "1 minute") -> DataFrame:
    """Outcome counts per tenant and minute (batch twin of the live roll-up)."""
    return log.groupBy(F.window("ts", width).alias("w"), "tenant_id", "outcome").agg(
        F.count("*").alias("requests")).select(
        F.col("w.start").alias("minute"), "tenant_id", "outcome", "requests")


def tenant_sessions(log: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """Stretches of traffic of a tenant without a pause longer than the gap.

    Rows in one gap-wide time slot always belong together, so only slot
    summaries are ordered per tenant, never the rows of a busy tenant.
    """
    micros = gap_seconds * 1_000_000
    at = F.unix_micros("ts")
    slots = log.groupBy("tenant_id", F.floor(at / micros).alias("slot")).agg(
        F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    w = Window.partitionBy("tenant_id").orderBy("slot")
    fresh = F.unix_micros("lo") - F.lag(F.unix_micros("hi")).over(w) > micros
    d = slots.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    d = d.withColumn("session", F.sum("fresh").over(w))
    return d.groupBy("tenant_id", "session").agg(
        F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"), F.sum("n").alias("requests")).select(
        "tenant_id", "first_ts", "last_ts", "requests")


def with_messages(entries: DataFrame, messages: DataFrame, redact: bool = False) -> DataFrame:
    """Audit rows with their request's messages in order, as (role, text).

    With ``redact`` the logged texts lose their personal data.  A request's messages are gathered
    in one row, as they came.
    """
    content = map_text(F.col("content"), pii.redact_pii) if redact else F.col("content")
    said = messages.select("request_id", F.struct("msg_idx", "role", message_text(content).alias("text")).alias("m"))
    said = said.groupBy("request_id").agg(F.array_sort(F.collect_list("m")).alias("m")).select(
        "request_id", F.transform("m", lambda m: m.dropFields("msg_idx")).alias("messages"))
    return entries.drop("messages").join(said, "request_id", "left")
