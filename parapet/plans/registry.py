"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame.

Results hold plain columns only (numbers and text), so that they can be compared
with SQL value by value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet.functions import checks, injection, pii, text
from parapet.operators import alerts as al
from parapet.operators import audit, chunks, limits, policy, verdicts
from parapet.operators import pii as pii_ops
from parapet.plans import cascade
from parapet.plans import datasets as ds
from parapet.sources import sse, tables, traffic
from parapet.sources.local import local_table
from parapet.storage import new_path, remove, written
from parapet.streaming import guard, limiter, lines, rollup

AS_OF = "2024-01-20 00:00:00"
#: Rows of a file of a live source, and files of a micro-batch at most.
LIVE_ROWS, LIVE_FILES = 500_000, 24


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def micros(name: str) -> Column:
    return F.unix_micros(name).alias(name)


# --- message text -----------------------------------------------------------

def message_text(spark, sf):
    return ds.messages(spark, sf).select("request_id", "msg_idx", text.message_text(F.col("content")).alias("text"))


def user_messages(spark, sf):
    return ds.messages(spark, sf).where(F.col("role") == "user").select("request_id", "msg_idx", "tenant_id")


def mapped_text(spark, sf):
    d = ds.messages(spark, sf).withColumn("content", text.map_text(F.col("content"), lambda t: F.translate(t, "aeiou", "AEIOU")))
    return d.select("request_id", "msg_idx", F.size("content").alias("blocks"),
                    text.message_text(F.col("content")).alias("text"))


def bearer_token(spark, sf):
    d = ds.table(spark, sf, "events")
    word = ds.pick(["Bearer ", "bearer   ", "BEARER ", "Basic ", "Bearer"], F.col("event_id") % 5)
    header = F.concat(word, F.lit("k"), F.col("user_id").cast("string"), F.lit("  "))
    return policy.with_bearer(d.select("event_id", header.alias("authorization"))).select(
        "event_id", F.col("proxy_key").alias("token"))


def message_preview(spark, sf):
    return al.previews(ds.messages(spark, sf), 200)


def normalized_text(spark, sf):
    return ds.messages(spark, sf).select(
        "request_id", "msg_idx", text.normalize_text(text.message_text(F.col("content"))).alias("text"))


# --- personal data ------------------------------------------------------------

def _documents(spark, sf):
    d = ds.table(spark, sf, "documents")
    return d.select("doc_id", "text", "lang", "source")


def pii_spans(spark, sf):
    d = _documents(spark, sf).where(pii.may_hold_pii(F.col("text")))
    return d.select("doc_id", F.explode(pii.pii_spans(F.col("text"))).alias("x")).select(
        "doc_id", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.ptype").alias("ptype"),
        F.col("x.value").alias("value"))


def pii_cards(spark, sf):
    d = pii_spans(spark, sf)
    return d.where(F.col("ptype") == "credit_card").select("doc_id", "s", "value")


def pii_redact(spark, sf):
    return _documents(spark, sf).select("doc_id", pii.redact_pii(F.col("text")).alias("text"))


def pii_redact_some(spark, sf):
    types = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("email"))).otherwise(F.array(F.lit("phone"), F.lit("credit_card")))
    return _documents(spark, sf).select("doc_id", pii.redact_pii(F.col("text"), types).alias("text"))


def pii_block(spark, sf):
    return verdicts.pii_verdict(ds.messages(spark, sf), ds.policies(spark))


def pii_profile(spark, sf):
    return pii_ops.pii_profile(_documents(spark, sf))


def _tokenized(spark, sf):
    rows = pii_ops.text_rows(ds.messages(spark, sf).drop("tenant_id", "role"))
    return pii_ops.tokenize_pii(rows)


def pii_tokenize(spark, sf):
    return _tokenized(spark, sf).texts.select("request_id", "msg_idx", "block_idx", "text")


def pii_vault(spark, sf):
    return _tokenized(spark, sf).vault


def pii_system_prompt(spark, sf):
    """System prompts share the vault of their request and come after all its messages."""
    n = F.col("conv_id").cast("string")
    prompt = F.concat(F.lit("Mail admin"), n, F.lit("@example.net or user"), n, F.lit("@example.com, call 555-867-5309 "), F.col("text"))
    first = ds.table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    system = first.select(F.col("conv_id").alias("request_id"), F.lit(pii_ops.SYSTEM_INDEX).alias("msg_idx"), F.lit(0).alias("block_idx"), prompt.alias("text"))
    rows = pii_ops.text_rows(ds.messages(spark, sf).drop("tenant_id", "role")).select(*system.columns).unionByName(system)
    done = pii_ops.tokenize_pii(rows).texts.where(F.col("msg_idx") == pii_ops.SYSTEM_INDEX)
    return done.select("request_id", "text")


def pii_restore(spark, sf):
    d = ds.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("msg_idx"),
        F.concat("text", F.lit(" [PII_EMAIL_1] [PII_EMAIL_2] [PII_EMAIL_3] [PII_PHONE_1] [PII_X_1]")).alias("text"))
    return pii_ops.restore_texts(d, _tokenized(spark, sf).vault, ["request_id", "msg_idx"])


# --- injection and topics -------------------------------------------------------

def injection_score(spark, sf):
    d = ds.messages(spark, sf).where(F.col("role") == "user")
    d = d.withColumn("x", injection.injection_score(text.message_text(F.col("content"))))
    return d.select("request_id", "msg_idx", F.col("x.score").alias("score"), F.array_join("x.reasons", ", ").alias("reasons"))


def injection_documents(spark, sf):
    d = _documents(spark, sf).withColumn("x", injection.injection_score(F.col("text")))
    return d.groupBy("source").agg(F.sum("x.score").alias("score"), F.count_if(F.col("x.score") >= 1).alias("blocked"),
                                   F.count("*").alias("documents"))


def injection_block(spark, sf):
    return verdicts.injection_verdict(ds.messages(spark, sf), ds.policies(spark))


def injection_profile(spark, sf):
    return verdicts.injection_profile(ds.messages(spark, sf))


def base64_payloads(spark, sf):
    d = ds.messages(spark, sf).select("request_id", "msg_idx", F.posexplode(injection.decode_base64_runs(
        text.message_text(F.col("content")))).alias("n", "payload"))
    return d


def topic_block(spark, sf):
    return verdicts.topic_verdict(ds.messages(spark, sf), ds.policies(spark))


# --- responses --------------------------------------------------------------------

def output_max_length(spark, sf):
    d = ds.table(spark, sf, "conversations")
    return d.select("conv_id", "turn", checks.length_error(F.col("text"), 300).alias("reason"))


def output_json_schema(spark, sf):
    d = ds.table(spark, sf, "events")
    n = F.col("event_id")
    # numbers that only their spelling tells apart, in every eleventh row
    odd = ['{"k": NaN}', '{"k": -Infinity, "v": "NaN 1.0"}', '{"k": 123456789012345678901234567890123456789012345}', '{"k": 1e999}', '{"k": 01}', '{"k": -NaN}']
    body = F.when(n % 11 == 0, ds.pick(odd, F.floor(n / 11) % len(odd))).when(
        n % 6 == 0, F.col("props")).when(n % 6 == 1, F.concat(F.col("props"), F.lit(" tail"))).when(
        n % 6 == 2, F.concat(F.lit('{"k": "'), F.col("event_type"), F.lit('"}'))).when(
        n % 6 == 3, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(
        n % 6 == 4, F.concat(F.lit('{"j": '), F.col("user_id").cast("string"), F.lit("}"))).otherwise(
        F.concat(F.lit('{"k": '), F.col("user_id").cast("string"), F.lit('.0, "v": null}')))
    schema = {"required": ["k"], "properties": {"k": {"type": "integer"}, "v": {"type": "string"}}}
    return d.select("event_id", checks.schema_error(body, schema).alias("reason"))


def toxicity_wordlist(spark, sf):
    d = ds.messages(spark, sf)
    return d.select("request_id", "msg_idx", checks.toxic_words(text.message_text(F.col("content"))).alias("toxic"))


def _moderated(spark, sf, provider):
    text = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text"))
    d = ds.table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), text.alias("text")).join(
        ds.moderation(spark, sf), "request_id", "left")
    # scores near ties of the second decimal
    score = F.when(F.col("score").isNotNull(), ds.pick(ds.TIES, F.col("request_id") % len(ds.TIES)))
    d = d.withColumn("score", score)
    return d.select("request_id", checks.toxicity_error(
        F.col("text"), F.lit(provider), F.lit(True), F.lit(0.1), F.col("flagged"), F.col("categories"),
        F.col("score")).alias("reason"))


def toxicity_labels(spark, sf):
    return _moderated(spark, sf, "openai")


def toxicity_threshold(spark, sf):
    return _moderated(spark, sf, "perspective")


def _restored_replies(spark, sf):
    """Replies with the tokens of the messages before them put back: one vault per conversation, read up to the reply."""
    said = ds.thread_messages(spark, sf).withColumnRenamed("thread_id", "request_id").drop("tenant_id", "role")
    vault = pii_ops.tokenize_pii(pii_ops.text_rows(said), positions=True).vault
    return pii_ops.restore_responses(ds.responses(spark, sf), vault, "thread_id", "upto")


def output_verdicts(spark, sf):
    return verdicts.output_verdicts(_restored_replies(spark, sf), ds.policies(spark), ds.exchange_moderation(spark, sf))


def restored_responses(spark, sf):
    return _restored_replies(spark, sf).select("request_id", "choice_idx", text.message_text(F.col("content")).alias("text"))


def output_blocks(spark, sf):
    """Replies of several blocks: their texts are checked as one, joined by a space."""
    said = ds.messages(spark, sf).where(F.col("role") == "assistant")
    replies = said.select(F.concat_ws("-", "request_id", "msg_idx").alias("request_id"), "tenant_id", F.lit(0).alias("choice_idx"), "content")
    return verdicts.output_verdicts(replies, ds.policies(spark), ds.exchange_moderation(spark, sf))


# --- whole requests -----------------------------------------------------------------

def input_verdicts(spark, sf):
    return verdicts.input_verdicts(ds.messages(spark, sf), ds.policies(spark)).select(
        "request_id", "tenant_id", "blocked", "guardrail", "reason")


def input_verdicts_unlisted(spark, sf):
    """Tenants outside the policy table follow the default tenant's policy."""
    d = ds.messages(spark, sf).withColumn("tenant_id", F.concat(F.lit("stranger"), F.col("request_id") % 3))
    return verdicts.input_verdicts(d, ds.policies(spark)).select("request_id", "tenant_id", "blocked", "guardrail", "reason")


def delivered_rows(spark, sf):
    """What clients of cut streams received."""
    d = written(ds.chunks(spark, sf), "chunks")
    return chunks.delivered(d, chunks.stream_outcomes(d, ds.policies(spark), _scores(d))).where(
        ~F.col("closes")).select("stream_id", "seq", "delta")


def forwarded_messages(spark, sf):
    d = cascade.check_inputs(ds.messages(spark, sf), ds.policies(spark)).messages
    return d.select("request_id", "msg_idx", text.message_text(F.col("content")).alias("text"))


def _outcomes(spark, sf):
    return cascade.run_cascade(
        written(ds.exchange_requests(spark, sf), "requests"), ds.thread_messages(spark, sf), ds.responses(spark, sf).drop("thread_id", "upto"),
        ds.policies(spark), ds.keys(spark), ds.request_accounts(spark), ds.small_plans(spark), ds.exchange_moderation(spark, sf),
        threads=ds.threads(spark, sf), streams=ds.exchange_streams(spark, sf), scores=ds.exchange_scores(spark, sf))


def request_outcomes(spark, sf):
    return _outcomes(spark, sf).select("request_id", "tenant_id", "api", "outcome", "guardrail", "reason",
                                       "prompt_tokens", "completion_tokens")


def cascade_audit(spark, sf):
    """The cascade's own log through the audit table: newest entries with their messages."""
    path = new_path(spark, "audit")
    tables.write_audit(_outcomes(spark, sf), path)
    newest = audit.recent_audit(tables.read_audit(spark, path), 500, api="openai")
    said = ds.thread_messages(spark, sf).join(ds.threads(spark, sf).join(newest.select("request_id"), "request_id"), "thread_id").where(
        F.col("msg_idx") < F.col("upto")).select("request_id", "msg_idx", "role", "content")
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return audit.with_messages(newest, said).select("request_id", "tenant_id", "outcome", "reason", shown.alias("messages"))


def cascade_alerts(spark, sf):
    """What tenants hear of the cascade's own outcomes; a request over its monthly cap raises no alert."""
    blocked = written(_outcomes(spark, sf).where((F.col("outcome") != "passed") & ~F.col("capped")), "blocked")
    said = ds.thread_messages(spark, sf).withColumnRenamed("thread_id", "request_id")
    places = ds.threads(spark, sf).withColumnRenamed("thread_id", "thread").join(blocked.select("request_id"), "request_id")
    d = al.alerts(blocked.join(al.prefix_previews(said, places), "request_id", "left"), ds.policies(spark))
    return d.select("request_id", "event", "tenant_id", "api", "url", *[
        F.get_json_object("payload", f"$.{k}").alias(k) for k in ("guardrail", "reason", "message_preview")])


def guardrail_report(spark, sf):
    d = ds.messages(spark, sf).select(
        (F.col("request_id") * 100 + F.col("msg_idx")).alias("request_id"), "tenant_id",
        text.message_text(F.col("content")).alias("text"), F.lit("Sent to [PII_EMAIL_1] and [PII_EMAIL_2]").alias("response"))
    d = cascade.guardrail_report(d, ds.policies(spark))
    shown = F.array_join(F.transform("checks", lambda c: F.concat_ws("|", c["guardrail"], c["status"], c["detail"])), ";")
    return d.select("request_id", "sanitized", "overall", shown.alias("checks"), "response")


def _alerts(spark, sf, secret=None):
    d = ds.audit_log(spark, sf).select(
        F.col("id").alias("request_id"), "ts", F.concat(F.lit("t"), F.col("id") % 4).alias("tenant_id"), "api", "outcome",
        F.lit(None).cast("string").alias("guardrail"), "reason", F.col("tenant_id").alias("message_preview"))
    return al.alerts(d, ds.policies(spark), secret)


def alerts(spark, sf):
    d = _alerts(spark, sf)
    return d.select("request_id", "event", "tenant_id", "api", "url",
                    F.get_json_object("payload", "$.reason").alias("reason"),
                    F.get_json_object("payload", "$.message_preview").alias("preview"))


def signed_alerts(spark, sf):
    return _alerts(spark, sf, "secret").select("request_id", "payload", "signature")


def resolve_tenant(spark, sf):
    d = policy.resolve_tenants(ds.requests(spark, sf), ds.keys(spark), ds.request_accounts(spark))
    return d.select("request_id", "tenant_id", "rejected")


def resolve_tenant_open(spark, sf):
    none = ds.keys(spark).where(F.lit(False))
    d = ds.requests(spark, sf).withColumn("header_tenant", F.when(F.col("request_id") % 2 == 0, F.lit("")).otherwise(F.lit("t7")))
    return policy.resolve_tenants(d, none, ds.request_accounts(spark)).select("request_id", "tenant_id", "rejected")


def policy_resolved(spark, sf):
    d = verdicts.with_policy(ds.requests(spark, sf).select(
        "request_id", F.when(F.col("request_id") % 5 == 4, "elsewhere").otherwise(
            F.concat(F.lit("t"), F.col("request_id") % 5)).alias("tenant_id")),
        ds.policies(spark), "input", "output", "rate_limit", "webhook")
    return d.select(
        "request_id", "tenant_id", F.col("input.pii.action").alias("pii_action"),
        F.array_join("input.pii.types", ",").alias("pii_types"),
        F.col("input.prompt_injection.enabled").alias("injection"), F.col("input.prompt_injection.threshold").alias("threshold"),
        F.array_join("input.topic_filter.blocked_topics", ",").alias("topics"), F.col("output.max_length").alias("max_length"),
        F.col("output.toxicity.provider").alias("provider"), F.col("rate_limit.enabled").alias("limited"),
        F.col("rate_limit.requests_per_minute").alias("rpm"), F.array_join("webhook.on", ",").alias("events"))


def requests_from_json(spark, sf):
    d = ds.table(spark, sf, "conversations")
    body = F.to_json(F.struct(
        F.lit(True).alias("stream"), F.when(F.col("conv_id") % 2 == 0, F.lit("be brief")).alias("system"),
        F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    d = traffic.requests_from_json(d.select((F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), body.alias("body")))
    rows = traffic.message_rows(d, ("request_id",))
    return rows.select("request_id", "role", text.message_text(F.col("content")).alias("text"))


def responses_from_json(spark, sf):
    d = ds.table(spark, sf, "conversations")
    even = F.col("conv_id") % 2 == 0
    a = F.to_json(F.struct(
        F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"))).alias("choices"),
        F.struct(F.col("turn").alias("prompt_tokens"), F.col("conv_id").alias("completion_tokens")).alias("usage")))
    b = F.to_json(F.struct(
        F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"),
        F.struct(F.col("turn").alias("input_tokens"), F.col("conv_id").alias("output_tokens")).alias("usage")))
    d = d.select((F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), F.when(even, a).otherwise(b).alias("body"))
    d = traffic.responses_from_json(d)
    return d.select("request_id", "choice_idx", text.message_text(F.col("content")).alias("text"), "prompt_tokens",
                    "completion_tokens")


# --- audit log -----------------------------------------------------------------------

def audit_stats(spark, sf):
    return audit.audit_stats_by_tenant(ds.audit_log(spark, sf)).unionByName(
        audit.audit_stats(ds.audit_log(spark, sf)).select(F.lit("*").alias("tenant_id"), "*"))


def top_block_reasons(spark, sf):
    return audit.top_block_reasons(ds.audit_log(spark, sf))


def token_metrics_by_api(spark, sf):
    return audit.token_metrics_by_api(ds.audit_log(spark, sf), as_of(), 7)


def token_metrics(spark, sf):
    d = audit.token_metrics(ds.audit_log(spark, sf), as_of(), 7)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("by_api")), lambda e: F.concat_ws(
        ":", e["key"], e["value"]["requests"], e["value"]["input_tokens"], e["value"]["output_tokens"])), ";")
    return d.withColumn("by_api", shown)


def token_metrics_rollup(spark, sf):
    return audit.token_metrics_rollup(ds.audit_log(spark, sf), as_of(), 7)


def monthly_usage(spark, sf):
    d = audit.monthly_usage(ds.audit_log(spark, sf))
    return d.select("tenant_id", F.date_format("month", "yyyy-MM").alias("month"), "passed_requests")


def recent_audit(spark, sf):
    d = audit.recent_audit(ds.audit_log(spark, sf), 50, api="openai", tenant="view", scoped="click")
    return d.select("id", micros("ts"), "tenant_id", "api", "outcome", "reason", "prompt_tokens", "completion_tokens")


def audit_sink(spark, sf):
    """The log as a stream of batches leaves it, some rows unfit and two batches written twice; faults show in place of reasons."""
    n = F.col("request_id")
    rows = ds.audit_log(spark, sf).withColumnRenamed("id", "request_id").select(
        "request_id", "ts", F.when(n % 101 != 0, F.col("tenant_id")).alias("tenant_id"), "api",
        F.when(n % 103 == 0, "unknown").otherwise(F.col("outcome")).alias("outcome"), "reason", "prompt_tokens", "completion_tokens")
    path, source, state = (new_path(spark, name) for name in ("audit", "audit-in", "audit-state"))
    files = _in_time_order(rows, source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", min(files, LIVE_FILES)).parquet(source)
    tables.stream_audit(stream, path, state).awaitTermination()
    # what a restart does: the last batch again, and the first
    batches = tables.next_batch(spark, path)
    ranges = tables.read_audit(spark, path).unionByName(tables.read_set_aside(spark, path), allowMissingColumns=True)
    for again in sorted({0, max(0, batches - 1)}):
        tables.write_audit(written(ranges.where(F.col("batch") == again).select(*rows.columns), "again"), path, again)
    remove(spark, source, state)
    kept, aside = tables.read_audit(spark, path), tables.read_set_aside(spark, path)
    out = kept.withColumn("fault", F.lit(None).cast("string")).unionByName(aside, allowMissingColumns=True)
    return out.select("id", "request_id", "tenant_id", "api", "outcome", F.coalesce("fault", "reason").alias("reason"), "prompt_tokens")


def account_usage(spark, sf):
    return audit.account_usage(ds.audit_log(spark, sf), ds.usage_accounts(spark), policy.plans_table(spark), as_of())


def audit_by_minute(spark, sf):
    d = audit.audit_by_minute(ds.audit_log(spark, sf))
    return d.select(micros("minute"), "tenant_id", "outcome", "requests")


def tenant_sessions(spark, sf):
    d = audit.tenant_sessions(ds.audit_log(spark, sf), 1800)
    return d.select("tenant_id", micros("first_ts"), micros("last_ts"), "requests")


# --- limits ----------------------------------------------------------------------------

def rate_limit_decisions(spark, sf):
    d = limits.rate_limit(ds.traffic(spark, sf), ds.limits(spark))
    return d.select("request_id", "tenant_id", "limited", "reason", "retry_after")


def rate_limit_status(spark, sf):
    decisions = limits.rate_limit(ds.traffic(spark, sf), ds.limits(spark))
    return limits.rate_limit_status(decisions, ds.limits(spark), as_of())


def request_rate(spark, sf):
    return limits.request_rate(ds.traffic(spark, sf), 3600).select("request_id", "tenant_id", "rate")


def monthly_cap(spark, sf):
    d = ds.traffic(spark, sf).withColumn("would_pass", F.col("request_id") % 10 > 2)
    accounts = local_table(spark, [("click", "tiny"), ("view", "free"), ("error", "odd")], "tenant_id string, plan string")
    return limits.monthly_cap(d, accounts, ds.small_plans(spark)).select("request_id", "tenant_id", "capped", "reason")


# --- streams -----------------------------------------------------------------------------

def stream_length_cutoff(spark, sf):
    return chunks.length_violations(ds.chunks(spark, sf), ds.policies(spark))


def stream_toxicity_cutoff(spark, sf):
    return chunks.word_violations(ds.chunks(spark, sf), ds.policies(spark))


def stream_check_points(spark, sf):
    return chunks.check_points(ds.chunks(spark, sf))


def _scores(d):
    return ds.chunk_scores(d, "stream_id", F.col("stream_id"))


def stream_outcome(spark, sf):
    d = written(ds.chunks(spark, sf), "chunks")
    return chunks.stream_outcomes(d, ds.policies(spark), _scores(d))


def _restored(spark, sf):
    d = ds.chunks(spark, sf).withColumn("closes", F.col("closes") & (F.col("stream_id") % 11 != 0))
    return chunks.restore_stream(d, ds.stream_vault(spark, sf))


def stream_restore(spark, sf):
    d = _restored(spark, sf)
    return d.where((F.col("delta") != "") | (F.col("flushed") != ""))


def stream_restored_text(spark, sf):
    """Whole text of each restored stream, as length and hash."""
    d = _restored(spark, sf)
    piece = F.concat("delta", "flushed")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", piece.alias("t")))), lambda x: x["t"]), "")
    return d.groupBy("stream_id").agg(F.sum(F.length(piece)).alias("chars"), F.md5(whole).alias("text_md5"),
                                      F.count_if(F.contains(piece, F.lit("@example.com"))).alias("restored"))


def _lines(spark, sf, shape):
    d = ds.chunks(spark, sf)
    if shape == "a":
        body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("delta").alias("content")).alias("delta"))).alias("choices")))
        line = F.when(F.col("finished"), F.lit("data: [DONE]")).when(F.col("closes"), F.lit(": ping")).otherwise(
            F.concat(F.lit("data: "), body))
        return d.select("stream_id", "seq", line.alias("line"))
    # every fiftieth body is broken, and every stream stops its content block before it ends
    body = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(
        F.lit("text_delta").alias("type"), F.col("delta").alias("text")).alias("delta")))
    body = F.when((F.col("stream_id") + F.col("seq")) % 50 == 7, F.lit('{"type": oops')).otherwise(body)

    def three(kind, text):
        return F.array(F.concat(F.lit("event: "), kind), F.concat(F.lit("data: "), text), F.lit(""))

    last = F.when(F.col("finished"), "message_stop").otherwise("ping")
    end = F.concat(three(F.lit("content_block_stop"), F.lit("{}")), three(last, F.lit("{}")))
    parts = F.posexplode(F.when(F.col("closes"), end).otherwise(three(F.lit("content_block_delta"), body)))
    return d.select("stream_id", (F.col("seq") * 3).alias("base"), parts.alias("i", "line")).select(
        "stream_id", (F.col("base") + F.col("i")).alias("seq"), "line")


def sse_openai(spark, sf):
    return sse.openai_deltas(_lines(spark, sf, "a"))


def sse_anthropic(spark, sf):
    return sse.anthropic_deltas(_lines(spark, sf, "b"))


# --- live jobs, run to the end of what there is -------------------------------------------

def _in_time_order(frame, path, at_least=1):
    """The rows as files of about ``LIVE_ROWS`` rows each, one range of time per file, ranges side by side; how many files there are.

    Equal times stay in one file.  A stream takes files by their age, so the files are given ages in order of time.
    """
    spark = frame.sparkSession
    # counted, sampled and dealt out: made once
    rows = new_path(spark, "live-rows")
    frame.write.parquet(rows)
    made = spark.read.schema(frame.schema).parquet(rows)
    ranged = made.repartitionByRange(max(at_least, -(-made.count() * 5 // (LIVE_ROWS * 4))), "ts")
    ranged.sortWithinPartitions("ts").write.parquet(path)
    remove(spark, rows)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for i, name in enumerate(names):
        files.setTimes(spark._jvm.org.apache.hadoop.fs.Path(folder, name), 1_000_000_000_000 + 1000 * i, -1)
    return len(names)


def _started(job, spark):
    """The writer's query, its state dealt over as many partitions as there are cores.

    Each micro-batch writes every partition's state, whether it holds rows or not.  A query keeps the settings it starts with.
    """
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, min(int(was), spark.sparkContext.defaultParallelism))
    try:
        return job.start()
    finally:
        spark.conf.set(name, was)


def _live(frame, build, in_order=False, at_least=1, files=LIVE_FILES):
    """Result of a streaming job over the frame's rows as files in the shared folder.

    ``in_order`` gives a range of time to each micro-batch: at most so many ``files`` of bounded size, and in all ``at_least``
    so many micro-batches where rows allow it.
    """
    spark = frame.sparkSession
    source, sink, at = (new_path(spark, name) for name in ("live-in", "live-out", "live-state"))
    reader = spark.readStream.schema(frame.schema)
    if in_order:
        found = _in_time_order(frame, source, at_least)
        reader = reader.option("maxFilesPerTrigger", max(1, min(files, found // at_least)))
    else:
        frame.write.parquet(source)
    result = build(reader.parquet(source))
    job = (result.writeStream.format("parquet").option("path", sink).option("checkpointLocation", at)
           .trigger(availableNow=True))
    _started(job, spark).awaitTermination()
    remove(spark, source, at)
    return spark.read.schema(result.schema).parquet(sink)


def rate_limit_live(spark, sf):
    """Calm requests are allowed from counts; each busy episode meets its own state, batch by batch."""
    requests, lims = ds.traffic(spark, sf), ds.limits(spark)
    busy = written(limits.busy_slots(requests, limits._limits(lims)).select("tenant_id", "slot", "episode", "hot"), "busy-slots")
    d = requests.withColumn("slot", F.floor(F.unix_micros("ts") / limits.SLOT)).join(busy, ["tenant_id", "slot"], "left")
    calm = d.where(~F.coalesce("hot", F.lit(False))).select(
        "request_id", "tenant_id", F.lit(False).alias("limited"), F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("int").alias("retry_after"))
    # rows of quiet slots only seed an episode; they are among the calm ones already
    rows = written(d.where(F.col("episode").isNotNull()).select("request_id", "ts", "tenant_id", "episode", "hot"), "busy-rows")
    out = _live(rows, lambda s: limiter.rate_limit_stream(s, lims, keys=["tenant_id", "episode"]), in_order=True, files=1)
    same = ["request_id", "ts", "tenant_id"]
    out = out.withColumn("request_id", F.col("request_id").cast("long")).join(rows.where("hot").select(same), same, "left_semi")
    return calm.unionByName(out.select(*calm.columns))


def audit_rollup_live(spark, sf):
    log = ds.audit_log(spark, sf).select("ts", "tenant_id", "outcome")
    # a row far ahead in time closes every window
    last = log.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("end").alias("tenant_id"), F.lit("end").alias("outcome"))
    d = _live(log.unionByName(last), rollup.audit_rollup).where("tenant_id <> 'end'")
    return d.select(micros("minute"), "tenant_id", "outcome", "requests")


def audit_rollup_late(spark, sf):
    """The roll-up over at least sixteen batches, where some rows of the first half come ten days after their time, counted apart."""
    log = ds.audit_log(spark, sf).select("id", "ts", "tenant_id", "outcome")
    span = log.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    if span["lo"] is None:
        return audit.audit_by_minute(log).select(micros("minute"), "tenant_id", "outcome", "requests", F.lit(False).alias("late"))
    half, end = F.lit(span["lo"] + (span["hi"] - span["lo"]) / 2), F.lit(span["hi"])
    late = (F.col("id") % 97 == 0) & (F.col("ts") < half)
    rows = log.select(F.when(late, F.col("ts") + F.expr("INTERVAL 10 DAYS")).otherwise(F.col("ts")).alias("arrived"), "ts", "tenant_id", "outcome")
    # a row far ahead in time closes every window
    far = end + F.expr("INTERVAL 30 DAYS")
    last = spark.range(1).select(far.alias("arrived"), far.alias("ts"), F.lit("end").alias("tenant_id"), F.lit("end").alias("outcome"))
    rows = rows.unionByName(last).withColumnRenamed("ts", "at").withColumnRenamed("arrived", "ts")
    took = _live(rows, lambda s: rollup.audit_rollup(s.drop("ts").withColumnRenamed("at", "ts")), in_order=True, at_least=16)
    apart = _live(rows, lambda s: rollup.late_rows(s.drop("ts").withColumnRenamed("at", "ts")), in_order=True, at_least=16)
    apart = apart.groupBy("minute", "tenant_id", "outcome").agg(F.sum("requests").alias("requests")).withColumn("late", F.lit(True))
    both = took.where("tenant_id <> 'end'").withColumn("late", F.lit(False)).unionByName(apart)
    return both.select(micros("minute"), "tenant_id", "outcome", "requests", "late")


def _guarded(out):
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return out.groupBy(F.col("stream_id").cast("long").alias("stream_id")).agg(
        F.sum(F.length("text")).alias("chars"), F.md5(whole).alias("text_md5"), F.max("outcome").alias("outcome"),
        F.max("guardrail").alias("guardrail"), F.max("reason").alias("reason"))


def stream_guard_live(spark, sf):
    """Per stream: what came through, as length and hash, and how it ended."""
    d = ds.chunks(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.least("seq", F.lit(100000))))
    vault = ds.stream_vault(spark, sf).select(F.col("request_id").alias("stream_id"), F.create_map("token", "value").alias("vault"))
    return _guarded(_live(d, lambda s: guard.guard_stream(s, ds.policies(spark), vault)))


def stream_guard_live_vault(spark, sf):
    """The same with a vault that fills up while the job runs: its rows come a little before their stream, in at least eight batches."""
    def at(stream, step):
        # streams start five seconds apart and send ten chunks a second
        return F.timestamp_millis(F.lit(1704067200000) + stream * 5000 + F.least(step, F.lit(3500)) * 100)

    sent = ds.chunks(spark, sf).withColumn("ts", at(F.col("stream_id"), F.col("seq") + 2))
    known = ds.stream_vault(spark, sf).select(F.col("request_id").alias("stream_id"), "token", "value").withColumn("ts", at(F.col("stream_id"), F.lit(0)))
    both = sent.unionByName(known, allowMissingColumns=True)

    def build(rows):
        of_vault = F.col("token").isNotNull()
        return guard.guard_stream(rows.where(~of_vault).drop("token", "value"), ds.policies(spark), rows.where(of_vault).select("stream_id", "ts", "token", "value"))

    return _guarded(_live(both, build, in_order=True, at_least=8))


def _decoded_live(spark, sf, shape, decode):
    """Lines as a stream of at least eight batches, cut anywhere between two lines."""
    place = F.least("seq", F.lit(12000)) * 10 + F.col("seq") % 10
    d = _lines(spark, sf, shape).withColumn("ts", F.timestamp_millis(F.lit(1704067200000) + F.col("stream_id") * 5000 + place))
    out = _live(d, decode, in_order=True, at_least=8)
    return out.withColumn("stream_id", F.col("stream_id").cast("long"))


def sse_openai_live(spark, sf):
    return _decoded_live(spark, sf, "a", lines.openai_stream)


def sse_anthropic_live(spark, sf):
    return _decoded_live(spark, sf, "b", lines.anthropic_stream)


# --- plans ---------------------------------------------------------------------------------

def _history(spark, sf):
    return policy.plan_history(ds.billing_events(spark, sf), ds.billing_accounts(spark, sf))


def plan_history(spark, sf):
    return _history(spark, sf).select("user_id", "plan", micros("valid_from"), micros("valid_to"))


def effective_limits(spark, sf):
    at = F.lit("1998-06-01 00:00:00").cast("timestamp")
    return policy.effective_limits(_history(spark, sf), policy.plans_table(spark), at)


QUERIES = {f.__name__: f for f in (
    message_text, user_messages, mapped_text, bearer_token, message_preview, normalized_text,
    pii_spans, pii_cards, pii_redact, pii_redact_some, pii_block, pii_profile, pii_tokenize, pii_vault, pii_system_prompt, pii_restore,
    injection_score, injection_documents, injection_block, injection_profile, base64_payloads, topic_block,
    output_max_length, output_json_schema, toxicity_wordlist, toxicity_labels, toxicity_threshold,
    output_verdicts, output_blocks, restored_responses, input_verdicts, input_verdicts_unlisted, forwarded_messages, request_outcomes, cascade_audit, cascade_alerts, guardrail_report,
    alerts, signed_alerts, resolve_tenant, resolve_tenant_open, policy_resolved, requests_from_json, responses_from_json,
    audit_stats, top_block_reasons, token_metrics_by_api, token_metrics, token_metrics_rollup, monthly_usage,
    recent_audit, audit_sink, account_usage, audit_by_minute, tenant_sessions,
    rate_limit_decisions, rate_limit_status, request_rate, monthly_cap,
    stream_length_cutoff, stream_toxicity_cutoff, stream_check_points, stream_outcome, delivered_rows, stream_restore,
    rate_limit_live, audit_rollup_live, audit_rollup_late, stream_guard_live, stream_guard_live_vault, stream_restored_text, sse_openai, sse_anthropic, sse_openai_live, sse_anthropic_live, plan_history, effective_limits)}

