"""Whole request paths: input check and rewrite, output check, outcome per request."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions import checks, injection, numbers, pii
from parapet.functions.text import map_text
from parapet.operators import chunks
from parapet.operators import limits as lim
from parapet.operators.folds import written
from parapet.operators.pii import TEXT_KEYS, restore_responses, text_rows, tokenize_pii
from parapet.operators.policy import resolve_tenants
from parapet.operators.verdicts import input_verdicts, output_verdicts, with_policy


class Checked(NamedTuple):
    verdicts: DataFrame
    messages: DataFrame
    vault: DataFrame


def check_inputs(messages: DataFrame, policies: DataFrame) -> Checked:
    """Verdict of every request, and the messages as they would be forwarded.

    Messages of blocked requests are dropped.  Redaction happens in place on the
    scan side; only tenants that tokenize pay for a shuffle of matching texts.
    """
    # used by every branch below: written once, so that no text is scored twice
    verdicts = written(input_verdicts(messages, policies))
    blocked = verdicts.where("blocked").select("request_id")
    d = with_policy(messages.join(blocked, "request_id", "left_anti"), policies, "input")
    config = F.col("input.pii")
    action = F.when(config["enabled"], config["action"]).otherwise("none")
    redacted = d.where(action != "tokenize").withColumn("content", F.when(
        action == "redact", map_text(F.col("content"), lambda t: pii.redact_pii(t, config["types"])),
    ).otherwise(F.col("content"))).drop("input")
    secret = d.where(action == "tokenize").withColumn("types", config["types"]).drop("input")
    tokens = tokenize_pii(text_rows(secret), F.col("types"))
    # texts with tokens only: the others keep their content
    changed = tokens.texts.where(F.contains("text", F.lit("[PII_"))).groupBy("request_id", "msg_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("block_idx", "text"))).alias("__new"))
    content = F.transform("content", lambda b, i: F.when(
        F.map_contains_key(F.col("__new"), i), b.withField("text", F.try_element_at(F.col("__new"), i))).otherwise(b))
    rewritten = secret.drop("types").join(changed, TEXT_KEYS[:2], "left").withColumn(
        "content", F.when(F.col("__new").isNotNull(), content).otherwise(F.col("content"))).drop("__new")
    return Checked(verdicts, redacted.unionByName(rewritten), written(tokens.vault))


def check_outputs(responses: DataFrame, vault: DataFrame, policies: DataFrame,
                  moderation: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Verdicts and restored responses: values are put back before validation."""
    restored = restore_responses(responses, vault)
    return written(output_verdicts(restored, policies, moderation)), restored


def check_threads(messages: DataFrame, prefixes: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts of requests that repeat a thread's messages up to some place, and the threads' vaults.

    ``messages`` have a thread_id; ``prefixes`` are (request_id, thread_id, tenant_id, upto).  Each message
    is scored once for a tenant, however many requests hold it.  Vault rows name thread and
    tenant as ``request_id`` and the message of their first appearance.
    """
    thread = F.struct("thread_id", "tenant_id")
    reach = prefixes.groupBy("thread_id", "tenant_id").agg(F.max("upto").alias("__reach"))
    said = written(messages.drop("tenant_id").join(reach, "thread_id").where(F.col("msg_idx") < F.col("__reach")).select(
        thread.alias("request_id"), "tenant_id", "msg_idx", "role", "content"), "threads")
    verdicts = written(input_verdicts(said, policies, prefixes.select("request_id", thread.alias("thread"), "upto", "tenant_id")))
    config = F.col("input.pii")
    secret = with_policy(said, policies, "input").where(config["enabled"] & (config["action"] == "tokenize"))
    secret = secret.withColumn("types", config["types"]).drop("input")
    return verdicts, written(tokenize_pii(text_rows(secret), F.col("types"), positions=True).vault)


def _stream_verdicts(streams: DataFrame, live: DataFrame, policies: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Of streamed requests: request_id, blocked, guardrail, reason; a stream that only broke off has no row.

    Streams are checked as the model sent them, before tokens are put back, and without a JSON schema.
    """
    sent = streams.withColumnRenamed("request_id", "stream_id").drop("tenant_id").join(
        live.select(F.col("request_id").alias("stream_id"), "tenant_id"), "stream_id")
    sent = written(sent, "streams")
    if scores is not None:
        scores = scores.withColumnRenamed("request_id", "stream_id")
    found = chunks.stream_outcomes(sent, policies, scores).where(F.col("outcome").isNotNull())
    return written(found.select(F.col("stream_id").alias("request_id"), (F.col("outcome") == "output_blocked").alias("blocked"),
                                "guardrail", "reason"))


def run_cascade(requests: DataFrame, messages: DataFrame, responses: DataFrame, policies: DataFrame,
                keys: DataFrame, accounts: DataFrame, plans: DataFrame, moderation: DataFrame | None = None,
                cap_hint: str = "Upgrade your plan to continue.", threads: DataFrame | None = None,
                streams: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Exactly one outcome per accepted request, as audit rows.

    Order: key, rate limit, monthly cap, input checks, output checks, toxicity.
    Each stage only sees the requests the one before let through; requests with a
    bad key and requests without a response leave no row.  ``policies`` are resolved for
    every tenant in use.

    A request with ``stream`` set takes its outcome from its chunks in ``streams`` (request_id, seq, delta,
    closes, finished) and the model's ``scores`` of them: cut at its first violation, or passed
    where it ended properly.  A stream that just ends leaves no row, and none has token counts.
    ``threads`` (request_id, thread_id, upto) says that messages belong to threads that requests repeat
    up to a place.
    """
    accepted = resolve_tenants(requests, keys, accounts).where(~F.col("rejected"))
    limits = policies.select("tenant_id", "rate_limit.*")
    decisions = lim.rate_limit(accepted, limits).select("request_id", "limited", F.col("reason").alias("rate_reason"))
    decisions = written(decisions)
    streamed = F.coalesce("stream", F.lit(False)) if "stream" in accepted.columns else F.lit(False)
    base = accepted.select("request_id", "ts", "tenant_id", "api", streamed.alias("stream")).join(decisions, "request_id")
    live = base.where(~F.col("limited")).select("request_id", "tenant_id", "stream")
    whole = live.where(~F.col("stream")).drop("stream")
    answers = responses.drop("tenant_id").join(whole, "request_id")
    if threads is None:
        inputs = check_inputs(messages.drop("tenant_id").join(live.drop("stream"), "request_id"), policies)
        seen = inputs.verdicts
        outputs, _ = check_outputs(answers, inputs.vault, policies, moderation)
    else:
        prefixes = written(threads.join(live, "request_id"), "prefixes")
        seen, vault = check_threads(messages, prefixes, policies)
        own = answers.join(prefixes.select("request_id", F.struct("thread_id", "tenant_id").alias("thread"), "upto"), "request_id")
        outputs = written(output_verdicts(restore_responses(own, vault, "thread", "upto"), policies, moderation))
    if streams is not None:
        outputs = outputs.unionByName(_stream_verdicts(streams, live.where("stream"), policies, scores))
    usage = answers.groupBy("request_id").agg(
        F.max("prompt_tokens").alias("prompt_tokens"), F.max("completion_tokens").alias("completion_tokens"))

    def named(d: DataFrame, prefix: str) -> DataFrame:
        return d.select("request_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("blocked", "guardrail", "reason")])

    d = (base.join(named(seen, "in"), "request_id", "left")
         .join(named(outputs, "out"), "request_id", "left").join(usage, "request_id", "left"))
    clean = (~F.col("limited") & ~F.coalesce("in_blocked", F.lit(False)) & (F.col("out_blocked") == F.lit(False)))
    d = d.withColumn("would_pass", F.coalesce(clean, F.lit(False)))
    caps = lim.monthly_cap(d.where(~F.col("limited")), accounts, plans, cap_hint).select(
        "request_id", "capped", F.col("reason").alias("cap_reason"))
    d = d.join(caps, "request_id", "left")
    capped, inb = F.coalesce("capped", F.lit(False)), F.coalesce("in_blocked", F.lit(False))
    outcome = (F.when(F.col("limited") | capped, "rate_limited").when(inb, "input_blocked")
               .when(F.col("out_blocked"), "output_blocked").when(F.col("would_pass"), "passed"))
    reason = (F.when(F.col("limited"), F.col("rate_reason")).when(capped, F.col("cap_reason"))
              .when(inb, F.col("in_reason")).when(F.col("out_blocked"), F.col("out_reason")))
    guardrail = F.when(~F.col("limited") & ~capped, F.when(inb, F.col("in_guardrail")).when(
        F.col("out_blocked"), F.col("out_guardrail")))
    passed = F.col("outcome") == "passed"
    return d.select(
        "request_id", "ts", "tenant_id", "api", outcome.alias("outcome"), reason.alias("reason"),
        guardrail.alias("guardrail"), capped.alias("capped"), "prompt_tokens", "completion_tokens").where(
        F.col("outcome").isNotNull()).withColumn(
        "prompt_tokens", F.when(passed, F.col("prompt_tokens"))).withColumn(
        "completion_tokens", F.when(passed, F.col("completion_tokens")))


def _text_vault(text: Column, spans: Column) -> Column:
    """Token of every distinct match of a single text, as map value -> token per type.

    Numbers follow first appearance per type, starting above literals in the text.
    """
    pairs = F.array_distinct(F.transform(spans, lambda s: F.struct(s["ptype"].alias("ptype"), s["value"].alias("value"))))
    taken = pii.token_literals(text)

    def token(p: Column) -> Column:
        same = F.filter(pairs, lambda q: q["ptype"] == p["ptype"])
        floor = F.coalesce(F.array_max(F.transform(
            F.filter(taken, lambda t: t["ptype"] == p["ptype"]), lambda t: t["n"])), numbers.zero())
        number = numbers.plus(floor, F.array_position(same, p))
        return F.concat(F.lit("[PII_"), F.upper(p["ptype"]), F.lit("_"), numbers.to_string(number), F.lit("]"))

    return F.transform(pairs, lambda p: F.struct(p["ptype"].alias("ptype"), p["value"].alias("value"), token(p).alias("token")))


def guardrail_report(prompts: DataFrame, policies: DataFrame) -> DataFrame:
    """Every input check of a single user text, with no short cut.

    ``prompts`` has request_id, tenant_id, text and optionally ``response``, whose
    tokens are then restored.  Row-local throughout.
    """
    d = with_policy(prompts, policies, "input")
    inp = F.col("input")
    d = d.withColumn("inj", F.when(inp["prompt_injection"]["enabled"], injection.injection_score(F.col("text"))))
    d = d.withColumn("topic_pos", F.array_min(checks.topics_found(F.col("text"), inp["topic_filter"]["blocked_topics"])))
    d = d.withColumn("spans", F.when(inp["pii"]["enabled"], pii.pii_spans(F.col("text"), inp["pii"]["types"])))
    limit = F.coalesce(F.nullif(inp["prompt_injection"]["threshold"], F.lit(0.0)), F.lit(1.0))
    inj_reason = F.when(F.col("inj.score") >= limit, injection.block_reason(F.col("inj.reasons")))
    topic = F.get(inp["topic_filter"]["blocked_topics"], F.col("topic_pos"))
    topic_reason = F.concat(F.lit("Request mentions blocked topic: '"), topic, F.lit("'"))
    has_pii = F.coalesce(F.size("spans") > 0, F.lit(False))
    action = inp["pii"]["action"]
    pii_reason = F.when(has_pii & (action == "block"), pii.block_reason(pii.span_types(F.col("spans"))))
    d = d.withColumn("vault", F.when(has_pii & (action == "tokenize"), _text_vault(F.col("text"), F.col("spans"))))
    tokenized = pii.replace_spans(F.col("text"), F.col("spans"), lambda s: F.get(F.transform(F.filter(
        F.col("vault"), lambda v: (v["ptype"] == s["ptype"]) & (v["value"] == s["value"])), lambda v: v["token"]), F.lit(0)))
    sanitized = (F.when(has_pii & (action == "redact"), pii.redact_spans(F.col("text"), F.col("spans")))
                 .when(has_pii & (action == "tokenize"), tokenized).otherwise(F.col("text")))
    detail = F.when(action == "tokenize", "PII replaced with reversible tokens (restored in the response)").otherwise(
        "PII found and redacted")
    rewritten = has_pii & action.isin("redact", "tokenize")

    def check(name: str, enabled: Column, reason: Column, soft: Column | None = None) -> Column:
        status = F.when(reason.isNotNull(), "blocked")
        text = F.when(reason.isNotNull(), reason)
        if soft is not None:
            status, text = status.when(soft, "redacted"), text.when(soft, detail)
        return F.when(enabled, F.struct(F.lit(name).alias("guardrail"), status.otherwise("passed").alias("status"),
                                        text.alias("detail")))

    listed = F.array_compact(F.array(
        check("Prompt Injection", inp["prompt_injection"]["enabled"], inj_reason),
        check("Topic Filter", inp["topic_filter"]["enabled"], topic_reason),
        check("PII Detection", inp["pii"]["enabled"], pii_reason, rewritten)))
    d = d.withColumn("checks", listed).withColumn("sanitized", sanitized)
    found = F.transform("checks", lambda c: c["status"])
    overall = F.when(F.array_contains(found, "blocked"), "blocked").when(
        F.array_contains(found, "redacted"), "redacted").otherwise("passed")
    out = ["request_id", F.col("text").alias("original"), "sanitized", overall.alias("overall"), "checks"]
    if "response" in prompts.columns:
        # a reply is only asked for where nothing blocks
        by_token = F.map_from_entries(F.transform("vault", lambda v: F.struct(v["token"], v["value"])))
        out.append(F.when(overall != "blocked", pii.restore_tokens(F.col("response"), by_token)).alias("response"))
    return d.select(*out)


