"""Alert rows for blocked requests, with an optional payload signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.text import hmac_sha256, text_blocks
from parapet.operators.scan import running
from parapet.operators.verdicts import with_policy


def previews(messages: DataFrame, n: int = 200) -> DataFrame:
    """First non-empty text of the last message of each request that has one."""
    first = F.get(F.filter(F.transform(text_blocks(F.col("content")), lambda b: b["text"]), lambda t: t != ""), F.lit(0))
    d = messages.select("request_id", "msg_idx", F.substring(first, 1, n).alias("t")).where(F.col("t").isNotNull())
    return d.groupBy("request_id").agg(F.max_by("t", "msg_idx").alias("message_preview"))


def prefix_previews(messages: DataFrame, prefixes: DataFrame, n: int = 200) -> DataFrame:
    """The preview of each request (request_id, thread, upto) that repeats a thread's messages (request_id: the thread)."""
    first = F.get(F.filter(F.transform(text_blocks(F.col("content")), lambda b: b["text"]), lambda t: t != ""), F.lit(0))
    said = messages.select(F.col("request_id").alias("thread"), F.col("msg_idx").cast("long").alias("at"), F.lit(1).alias("kind"),
                           F.substring(first, 1, n).alias("t")).where(F.col("t").isNotNull())
    marks = prefixes.select("thread", F.col("upto").cast("long").alias("at"), F.lit(0).alias("kind"), "request_id")
    d = running(said.unionByName(marks, allowMissingColumns=True), ["thread"], ["at", "kind"], F.floor(F.col("at") / 4096),
                maxes={"__last": F.when(F.col("t").isNotNull(), F.struct("at", "t"))})
    return d.where("kind = 0").select("request_id", F.col("__last.t").alias("message_preview"))


def alerts(outcomes: DataFrame, policies: DataFrame, secret: Column | str | None = None) -> DataFrame:
    """Payload rows of the outcomes a tenant wants to hear about.

    ``outcomes`` has request_id, ts, tenant_id, api, outcome, guardrail, reason and
    message_preview.  With a secret, ``signature`` signs the payload text.
    """
    hook = F.col("webhook")
    d = with_policy(outcomes, policies, "webhook").where(
        hook["enabled"] & (F.coalesce(hook["url"], F.lit("")) != "") & F.array_contains(hook["on"], F.col("outcome")))
    payload = F.to_json(F.struct(
        F.col("outcome").alias("event"), "tenant_id", "api", "guardrail", "reason",
        (F.unix_micros("ts") / 1_000_000).alias("timestamp"),
        F.coalesce("message_preview", F.lit("")).alias("message_preview")), {"ignoreNullFields": "false"})
    d = d.select("request_id", F.col("outcome").alias("event"), "tenant_id", "api", hook["url"].alias("url"),
                 payload.alias("payload"))
    if secret is not None:
        key = secret if isinstance(secret, Column) else F.lit(secret)
        d = d.withColumn("signature", F.concat(F.lit("sha256="), hmac_sha256(key, F.col("payload"))))
    return d
