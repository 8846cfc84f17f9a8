"""Tenant policies, proxy keys, plans and billing state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parapet import fixed_values as fv
from parapet import schemas
from parapet.functions.text import bearer_token
from parapet.operators.scan import lookup
from parapet.sources.local import local_table


def plans_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, fv.PLANS, schemas.PLAN)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _filled(raw: Column) -> list[Column]:
    """Typed sections of a merged policy; missing fields take built-in defaults."""
    pii, inj, topic = raw["input"]["pii"], raw["input"]["prompt_injection"], raw["input"]["topic_filter"]
    tox = raw["output"]["toxicity"]
    limit, hook = raw["rate_limit"], raw["webhook"]

    def default(value: Column, fallback) -> Column:
        return F.coalesce(value, fallback if isinstance(fallback, Column) else F.lit(fallback))

    return [
        F.struct(
            F.struct(default(pii["enabled"], True).alias("enabled"),
                     default(pii["action"], "redact").alias("action"),
                     default(pii["types"], _strings(fv.DEFAULT_PII_TYPES)).alias("types")).alias("pii"),
            F.struct(default(inj["enabled"], True).alias("enabled"),
                     default(inj["action"], "block").alias("action"),
                     default(inj["threshold"], 1.0).alias("threshold")).alias("prompt_injection"),
            F.struct(default(topic["enabled"], False).alias("enabled"),
                     default(topic["action"], "block").alias("action"),
                     default(F.transform(topic["blocked_topics"], F.lower), _strings([])).alias("blocked_topics"),
                     ).alias("topic_filter")).alias("input"),
        F.struct(
            raw["output"]["max_length"].alias("max_length"),
            F.struct(default(tox["enabled"], True).alias("enabled"),
                     default(tox["provider"], "wordlist").alias("provider"),
                     default(tox["threshold"], 0.8).alias("threshold")).alias("toxicity"),
            raw["output"]["json_schema"].alias("json_schema")).alias("output"),
        F.struct(default(limit["enabled"], False).alias("enabled"),
                 limit["requests_per_minute"].alias("requests_per_minute"),
                 limit["requests_per_hour"].alias("requests_per_hour")).alias("rate_limit"),
        F.struct(default(hook["enabled"], False).alias("enabled"), hook["url"].alias("url"),
                 default(hook["on"], _strings(fv.DEFAULT_ALERT_EVENTS)).alias("on")).alias("webhook"),
    ]


SECTIONS = ["input", "output", "rate_limit", "webhook"]


def resolve_policies(tenants: DataFrame, raw_policies: DataFrame) -> DataFrame:
    """One effective policy per tenant.

    A tenant's section replaces the default tenant's whole section; fields
    missing inside a section take the built-in defaults.  Unknown tenants get
    the default tenant's policy.
    """
    # every tenant meets two config rows: its own and the default tenant's
    asked = tenants.select("tenant_id").distinct().select("tenant_id", F.explode(F.array_distinct(F.array(
        F.col("tenant_id"), F.lit(fv.DEFAULT_TENANT)))).alias("source"))
    met = lookup(asked, raw_policies.withColumnRenamed("tenant_id", "source"), ["source"])

    def section(name: str, own: bool) -> Column:
        is_own = F.col("source") == F.col("tenant_id")
        return F.first(F.when(is_own if own else ~is_own, F.col(name)), ignorenulls=True)

    d = met.groupBy("tenant_id").agg(
        *[F.coalesce(section(s, True), section(s, False)).alias(s) for s in SECTIONS])
    raw = F.struct(*SECTIONS)
    return d.select("tenant_id", raw.alias("raw")).select("tenant_id", *_filled(F.col("raw")))


def account_plans(accounts: DataFrame, plans: DataFrame) -> DataFrame:
    """Accounts with their plan's columns; an unknown plan counts as free."""
    names = plans.select("plan", F.col("plan").alias("known"))
    d = lookup(accounts, names, ["plan"]).withColumn("plan_used", F.coalesce("known", F.lit("free"))).drop("known")
    return lookup(d, plans.withColumnRenamed("plan", "plan_used"), ["plan_used"])


def resolve_tenants(requests: DataFrame, proxy_keys: DataFrame, accounts: DataFrame) -> DataFrame:
    """Tenant of each request from its key; ``rejected`` where the key is not valid.

    Accounts come first, then the key table.  With an empty key table every key
    is accepted and the tenant comes from the request header.
    """
    users = accounts.select(F.col("proxy_key"), F.col("tenant_id").alias("account_tenant"))
    keys = proxy_keys.where(F.coalesce("enabled", F.lit(True))).select(
        F.col("key").alias("proxy_key"), F.coalesce("tenant_id", F.lit(fv.DEFAULT_TENANT)).alias("key_tenant"))
    open_access = proxy_keys.agg(F.count("*") == 0).scalar()
    d = requests.withColumn("proxy_key", F.nullif(F.col("proxy_key"), F.lit("")))
    d = lookup(lookup(d, users, ["proxy_key"]), keys, ["proxy_key"]).withColumn("open_access", open_access)
    found = F.coalesce("account_tenant", F.when(F.col("open_access"), F.lit(fv.HEADER_TENANT)).otherwise(F.col("key_tenant")))
    from_header = F.coalesce(F.nullif(F.col("header_tenant"), F.lit("")), F.lit(fv.DEFAULT_TENANT))
    return (d.withColumn("rejected", found.isNull())
            .withColumn("tenant_id", F.when(found == fv.HEADER_TENANT, from_header).otherwise(found))
            .drop("account_tenant", "key_tenant", "open_access"))


def with_bearer(requests: DataFrame, header: str = "authorization") -> DataFrame:
    return requests.withColumn("proxy_key", bearer_token(F.col(header)))


def plan_changes(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Plan changes that billing events cause: (user_id, ts, seq, plan).

    ``seq`` orders events of one time; without it they count as equal.
    """
    kind = F.col("type")
    known = F.col("plan").isin([p[0] for p in fv.PLANS])
    downgrade = (
        kind.isin("customer.subscription.deleted", "customer.subscription.paused")
        | ((kind == "customer.subscription.updated") & F.col("status").isin("past_due", "unpaid"))
        | ((kind == "invoice.payment_failed") & (F.col("status") == "open")
           & (F.coalesce("attempt_count", F.lit(1)) >= 3)))
    bought = (kind == "checkout.session.completed") & F.col("user_id").isNotNull() & known
    moves = events.withColumn("new_plan", F.when(bought, F.col("plan")).when(downgrade, F.lit("free"))).where(
        F.col("new_plan").isNotNull())
    by_customer = accounts.where(F.col("customer").isNotNull()).select("customer", F.col("user_id").alias("owner"))
    moves = moves if "seq" in moves.columns else moves.withColumn("seq", F.lit(0).cast("long"))
    direct = moves.where(bought).select("user_id", "ts", "seq", F.col("new_plan").alias("plan"))
    through = lookup(moves.where(~bought), by_customer, ["customer"], "inner").select(
        F.col("owner").alias("user_id"), "ts", "seq", F.col("new_plan").alias("plan"))
    return direct.unionByName(through)


def plan_history(events: DataFrame, accounts: DataFrame, block_days: int = 30) -> DataFrame:
    """Validity ranges of each user's plan, from the changes in event order.

    Of changes at one time the last in sequence counts; changes to the plan already held are dropped.  Events of one user are cut
    into time blocks, so a user with very many events is not one task's work.
    """
    changes = plan_changes(events, accounts).groupBy("user_id", "ts").agg(
        F.max(F.struct("seq", "plan"))["plan"].alias("plan"))
    seconds = F.unix_micros("ts")
    block = F.floor(seconds / (block_days * 86_400_000_000))
    state = F.struct(seconds.alias("at"), F.col("plan").alias("plan"))

    def neighbour(d: DataFrame, backwards: bool, out: str) -> DataFrame:
        sign = -1 if backwards else 1
        w = Window.partitionBy("user_id", "__b").orderBy(F.col("ts").asc() if not backwards else F.col("ts").desc())
        edge = d.groupBy("user_id", "__b").agg((F.min if backwards else F.max)(state).alias("__edge"))
        ew = Window.partitionBy("user_id").orderBy(F.col("__b") * sign)
        edge = edge.select("user_id", "__b", F.lag("__edge").over(ew).alias("__before"))
        return (d.withColumn("__in", F.lag(state).over(w)).join(edge, ["user_id", "__b"])
                .withColumn(out, F.coalesce("__in", "__before")).drop("__in", "__before"))

    d = neighbour(changes.withColumn("__b", block), False, "__prev")
    d = d.where(F.col("__prev").isNull() | (F.col("__prev.plan") != F.col("plan"))).drop("__prev")
    d = neighbour(d, True, "__next")
    return d.select("user_id", "plan", F.col("ts").alias("valid_from"),
                    F.timestamp_micros("__next.at").alias("valid_to"))


def effective_limits(history: DataFrame, plans: DataFrame, as_of: Column) -> DataFrame:
    """Rate limits each user has at a time, from the plan valid then."""
    live = history.where((F.col("valid_from") <= as_of)
                         & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of)))
    return lookup(live, plans, ["plan"]).select(
        "user_id", "plan", F.col("rpm").alias("requests_per_minute"), F.col("rph").alias("requests_per_hour"))

