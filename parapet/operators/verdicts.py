"""Per-request verdicts over message and response rows.

Message rows carry ``request_id, tenant_id, msg_idx, role, content``; policies are
the output of ``resolve_policies``.  Each check turns a message into a few small
values on the scan side, and one aggregation by request picks the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet import fixed_values as fv
from parapet.functions import checks, injection, patterns, pii
from parapet.functions.text import message_text
from parapet.operators.pii import mask_types, type_mask
from parapet.operators.scan import lookup, preceding_text, running
from parapet.storage import written

# Role of a top-level system prompt: checked for personal data only.
SYSTEM_ROLE = "__system"


def with_policy(rows: DataFrame, policies: DataFrame, *sections: str) -> DataFrame:
    """Rows with their tenant's policy; a tenant without one gets the default tenant's."""
    spare = policies.where(F.col("tenant_id") == fv.DEFAULT_TENANT).agg(F.first(F.struct(*sections))).scalar()
    d = lookup(rows, policies.select("tenant_id", *sections), ["tenant_id"])
    return d.withColumns({s: F.coalesce(s, spare[s]) for s in sections})


def _injection_reason(role: Column, text: Column, config: Column) -> Column:
    """Reason of a blocked user message."""
    asked = F.coalesce(config["enabled"], F.lit(False)) & (role == "user") & (text != "")
    limit = F.coalesce(F.nullif(config["threshold"], F.lit(0.0)), F.lit(1.0))
    scored = injection.injection_score(F.when(asked, text))
    return patterns.let(F.struct(scored.alias("x"), limit.alias("limit")), lambda b: F.when(
        b["x"]["score"] >= b["limit"], injection.block_reason(b["x"]["reasons"])))


def _spanning_topics(messages: DataFrame, policies: DataFrame) -> DataFrame:
    """Topics with blanks that begin in one message and end in a later one.

    Only the ends of messages move: the characters before a message that a topic
    could reach back to, and as many from its start.
    """
    topics = F.col("input.topic_filter.blocked_topics")
    longest = policies.where("input.topic_filter.enabled").agg(
        F.max(F.array_max(F.transform(topics, lambda t: F.when(F.contains(t, F.lit(" ")), F.length(t)))))).first()[0]
    rows = messages.where(F.exists(F.col("topics"), lambda t: F.contains(t, F.lit(" "))))
    if not longest:
        return None
    width = longest + 1
    ends = rows.select("request_id", "msg_idx", "topics", F.right("text", F.lit(width)).alias("tail"),
                       F.left("text", F.lit(width)).alias("head"), (F.length("text") > width).alias("cut"))
    d = running(ends, ["request_id"], ["msg_idx"], F.floor(F.col("msg_idx") / 4096), sums={"rank": F.lit(1)})
    d = preceding_text(d, ["request_id"], "rank", F.col("tail"), width, "before", " ")
    edge = F.concat(F.when(F.length("before") < width, " ").otherwise(""), F.col("before"), F.lit(" "),
                    F.col("head"), F.when(F.col("cut"), "").otherwise(" "))
    inner = F.transform("topics", lambda t, i: F.when(
        F.contains(t, F.lit(" ")) & F.rlike(edge, F.concat(
            F.lit("(?isu)(?<=.)" + patterns.BOUNDARY), patterns.quoted(t), F.lit(patterns.BOUNDARY + "(?=.)"))), i))
    return d.where(F.col("rank") > 1).select("request_id", "msg_idx", F.array_min(inner).alias("topic_pos")).where(
        F.col("topic_pos").isNotNull())


def _topic_rows(d: DataFrame) -> DataFrame:
    return d.withColumn("topics", F.when(
        F.coalesce(F.col("input.topic_filter.enabled"), F.lit(False)) & (F.col("role") != SYSTEM_ROLE),
        F.col("input.topic_filter.blocked_topics")))


def message_checks(messages: DataFrame, policies: DataFrame,
                   only: tuple[str, ...] = ("injection", "topic", "pii")) -> DataFrame:
    """Per message: injection reason, first topic position, personal-data type bits."""
    d = _topic_rows(with_policy(messages, policies, "input"))
    text = message_text(F.col("content"))
    d = d.withColumn("text", text)
    config = F.col("input.pii")
    spans = F.aggregate(
        F.filter("content", lambda b: b["type"] == "text"), F.lit(0),
        lambda acc, b: acc.bitwiseOR(patterns.let(pii.pii_spans(b["text"], config["types"]), type_mask)))
    none = F.lit(None)
    return d.select(
        "request_id", "msg_idx", "tenant_id", "topics", "input",
        (_injection_reason(F.col("role"), F.col("text"), F.col("input.prompt_injection"))
         if "injection" in only else none.cast("string")).alias("injection_reason"),
        (F.array_min(checks.topics_found(F.col("text"), F.col("topics")))
         if "topic" in only else none.cast("int")).alias("topic_pos"),
        (F.when(config["enabled"], spans) if "pii" in only else none.cast("int")).alias("pii_mask"))


def _at_prefixes(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """What the messages before ``upto`` show, for each prefix (request_id, thread, upto, tenant_id) of a thread.

    Facts only ever add up along a thread, so one running pass over facts and prefixes
    answers all prefixes, however many a thread has.
    """
    bits = len(fv.PII_PATTERNS)
    facts = rows.where("injection_reason IS NOT NULL OR topic_pos IS NOT NULL OR pii_mask <> 0").select(
        F.col("request_id").alias("thread"), F.col("msg_idx").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(
            prefixes.schema["request_id"].dataType).alias("request_id"), F.lit(None).cast("string").alias("tenant_id"),
        "injection_reason", "topic_pos", "pii_mask")
    marks = prefixes.select("thread", F.col("upto").cast(rows.schema["msg_idx"].dataType).alias("at"), F.lit(0).alias("kind"),
                            "request_id", "tenant_id")
    first = F.when(F.col("injection_reason").isNotNull(), F.struct(-F.col("at"), F.col("injection_reason").alias("reason")))
    d = running(facts.unionByName(marks, allowMissingColumns=True), ["thread"], ["at", "kind"], F.floor(F.col("at") / 4096), maxes={
        "__first": first, "__topic": -F.col("topic_pos"),
        **{f"__bit{i}": F.shiftright("pii_mask", i).bitwiseAND(1) for i in range(bits)}})
    mask = sum((F.coalesce(F.col(f"__bit{i}"), F.lit(0)) * (1 << i) for i in range(1, bits)), F.coalesce("__bit0", F.lit(0)))
    return d.where("kind = 0").select("request_id", "tenant_id", F.col("__first.reason").alias("injection_reason"),
                                      (-F.col("__topic")).alias("topic_pos"), mask.alias("pii_mask"))


def request_checks(messages: DataFrame, policies: DataFrame, only: tuple[str, ...] = ("injection", "topic", "pii"),
                   prefixes: DataFrame | None = None) -> DataFrame:
    """Per request: first blocked message, first topic in list order, all types found.

    With ``prefixes``, messages belong to threads and each request sees those before its ``upto``.
    """
    rows = message_checks(messages, policies, only)
    if "topic" in only:
        texts = _topic_rows(with_policy(messages, policies, "input")).withColumn("text", message_text(F.col("content")))
        spanning = _spanning_topics(texts, policies)
        if spanning is not None:
            rows = rows.unionByName(spanning, allowMissingColumns=True)
    if prefixes is not None:
        # filtered and read twice: written, or every message would be scored four times
        rows = written(rows.select("request_id", "msg_idx", "injection_reason", "topic_pos", "pii_mask"), "facts")
    d = _at_prefixes(rows, prefixes) if prefixes is not None else rows.groupBy("request_id").agg(
        F.first("tenant_id", ignorenulls=True).alias("tenant_id"),
        F.min_by("injection_reason", F.when(F.col("injection_reason").isNotNull(), F.col("msg_idx"))).alias("injection_reason"),
        F.min("topic_pos").alias("topic_pos"), F.bit_or("pii_mask").alias("pii_mask"))
    d = with_policy(d, policies, "input")
    topic = F.get(F.col("input.topic_filter.blocked_topics"), F.col("topic_pos"))
    return d.withColumn("topic", topic).withColumn(
        "topic_reason", F.concat(F.lit("Request mentions blocked topic: '"), topic, F.lit("'"))).withColumn(
        "pii_types", mask_types(F.coalesce("pii_mask", F.lit(0)))).withColumn(
        "pii_reason", F.when((F.col("input.pii.action") == "block") & (F.col("pii_mask") != 0),
                             pii.block_reason(F.col("pii_types"))))


def injection_verdict(messages: DataFrame, policies: DataFrame) -> DataFrame:
    d = request_checks(messages, policies, ("injection",))
    return d.select("request_id", F.col("injection_reason").isNotNull().alias("blocked"),
                    F.col("injection_reason").alias("reason"))


def topic_verdict(messages: DataFrame, policies: DataFrame) -> DataFrame:
    d = request_checks(messages, policies, ("topic",))
    return d.select("request_id", F.col("topic").isNotNull().alias("blocked"), F.col("topic_reason").alias("reason"))


def pii_verdict(messages: DataFrame, policies: DataFrame) -> DataFrame:
    d = request_checks(messages, policies, ("pii",))
    return d.select("request_id", F.col("pii_reason").isNotNull().alias("blocked"), F.col("pii_reason").alias("reason"))


def input_verdicts(messages: DataFrame, policies: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """First blocking check of each request, in the order injection, topic, personal data."""
    d = request_checks(messages, policies, prefixes=prefixes)
    verdict = F.coalesce(*[F.when(F.col(reason).isNotNull(), F.struct(
        F.lit(name).alias("guardrail"), F.col(reason).alias("reason"))) for name, reason in (
        ("prompt_injection", "injection_reason"), ("topic_filter", "topic_reason"), ("pii", "pii_reason"))])
    return d.withColumn("v", verdict).select(
        "request_id", "tenant_id", F.col("v").isNotNull().alias("blocked"), F.col("v.guardrail").alias("guardrail"),
        F.col("v.reason").alias("reason"), "pii_types")


def injection_profile(messages: DataFrame) -> DataFrame:
    """Messages per tenant and signature category."""
    scored = messages.where(F.col("role") == "user").select(
        "tenant_id", injection.injection_score(message_text(F.col("content")))["categories"].alias("categories"))
    # an inner explode would test the categories first, and score every text a second time for it
    return scored.select("tenant_id", F.explode_outer("categories").alias("category")).where("category IS NOT NULL").groupBy(
        "tenant_id", "category").agg(F.count("*").alias("messages"))


# --- responses ---------------------------------------------------------------

def response_checks(responses: DataFrame, policies: DataFrame, moderation: DataFrame | None = None) -> DataFrame:
    """Validation error of each response choice, and toxicity of the first choice."""
    d = with_policy(responses, policies, "output").withColumn("text", message_text(F.col("content")))
    if moderation is not None:
        d = d.join(moderation.select("request_id", "flagged", "categories", "score"), ["request_id"], "left")
    else:
        d = d.select("*", F.lit(None).cast("boolean").alias("flagged"),
                     F.lit(None).cast("map<string,boolean>").alias("categories"),
                     F.lit(None).cast("double").alias("score"))
    tox = F.col("output.toxicity")
    return d.select(
        "request_id", "choice_idx",
        checks.output_error(F.col("text"), F.col("output.max_length"), F.col("output.json_schema")).alias("error"),
        F.when(F.col("choice_idx") == 0, checks.toxicity_error(
            F.col("text"), tox["provider"], tox["enabled"], tox["threshold"],
            F.col("flagged"), F.col("categories"), F.col("score"))).alias("toxicity"))


def output_verdicts(responses: DataFrame, policies: DataFrame, moderation: DataFrame | None = None) -> DataFrame:
    """First failing choice of each response, then toxicity of its first choice."""
    per_choice = response_checks(responses, policies, moderation)
    d = per_choice.groupBy("request_id").agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("choice_idx"))).alias("error"),
        F.max("toxicity").alias("toxicity"))
    return d.select(
        "request_id", F.coalesce("error", "toxicity").isNotNull().alias("blocked"),
        F.when(F.col("error").isNotNull(), "output_validator").when(
            F.col("toxicity").isNotNull(), "toxicity").alias("guardrail"),
        F.coalesce("error", "toxicity").alias("reason"))
