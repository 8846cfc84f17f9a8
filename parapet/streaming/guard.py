"""Checks and token restoring on live response chunks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from parapet import fixed_values as fv
from parapet.operators.chunks import LONGEST_TOKEN
from parapet.operators.scan import lookup
from parapet.streaming.buckets import IDLE_MS, bucket, set_alarm, streams_of

OUT = "stream_id string, seq long, text string, outcome string, guardrail string, reason string, check_due boolean"
STATE = ("streams array<string>, last array<bigint>, totals array<bigint>, recent array<string>, held array<string>, "
         "checked array<bigint>, ended array<boolean>, vaults array<map<string,string>>")
READ = ["seq", "delta", "closes", "finished", "max_length", "words", "scored", "is_chunk", "token", "value", "vault"]

_PARTIAL = re.compile(fv.PARTIAL_TOKEN_PATTERN + r"\n?\Z")
_TOKEN = re.compile(fv.TOKEN_PATTERN)
_WORDS = [re.compile(p, re.IGNORECASE) for p in fv.TOXICITY_PATTERNS]
_REACH = fv.TOXICITY_LONGEST_MATCH + 1


def _toxic(before: str, delta: str) -> bool:
    """A listed word ends in the new text; a match may not start at the cut edge."""
    cut = len(before) >= _REACH
    text = before + delta
    return any(m.end() > len(before) for p in _WORDS for m in p.finditer(text, 1 if cut else 0))


def _follow(stream, rows, entry, out):
    """Add what a stream's rows of a micro-batch release to ``out``; the stream's new entry."""
    total, recent, held, checked, ended, vault = entry
    longest = max([LONGEST_TOKEN, *map(len, vault)])
    for seq, delta, closes, finished, max_length, words, scored, is_chunk, token, value, known in rows:
        if token is not None:
            vault[token] = value
            longest = max(longest, len(token))
        if not is_chunk:
            continue
        if ended:
            break
        outcome = guardrail = reason = None
        text, due = "", False
        if delta:
            total += len(delta)
            if max_length and max_length == max_length and total > max_length:
                guardrail, reason = "output_validator", (
                    f"Response exceeds max length ({total} > {int(max_length)} chars)")
            elif words and _toxic(recent, delta):
                guardrail, reason = "toxicity", "Response contains toxic content"
            recent = (recent + delta)[-_REACH:]
            if reason is None and scored and total - checked >= fv.MODEL_CHECK_INTERVAL:
                checked, due = total, True
        if reason is not None:
            outcome, ended = "output_blocked", True
        else:
            if not vault and known is not None:
                vault = json.loads(known)
                longest = max([LONGEST_TOKEN, *map(len, vault)])
            text = held + (delta or "")
            held = ""
            # without tokens there is nothing to wait for
            if vault and "[" in text:
                tail = None if closes else _PARTIAL.search(text[-longest:])
                if tail:
                    text, held = text[:len(text) - len(tail.group())], text[len(text) - len(tail.group()):]
                text = _TOKEN.sub(lambda m: vault.get(m.group(), m.group()), text)
            if finished:
                outcome, ended = "passed", True
        if text or outcome or due:
            out.append((stream, int(seq), text, outcome, guardrail, reason, due))
    return total, recent, held, checked, ended, vault


def _advance(key, batches, state):
    known = {s: (last, *entry) for s, last, *entry in zip(*state.get)} if state.exists else {}
    seen, out = {}, []
    if not state.hasTimedOut:
        pdf = pd.concat(list(batches))
        times, columns = pdf["ms"].to_numpy(), [pdf[c].to_numpy(object) for c in READ]
        # vault rows of a micro-batch are known before its chunks
        for stream, places in streams_of(pdf, key, ["is_chunk", "seq"]):
            _, *entry = known.pop(stream, (0, 0, "", "", 0, False, {}))
            entry = _follow(stream, zip(*[c[places].tolist() for c in columns]), entry, out)
            # an idle stream is dropped an hour after its last chunk
            seen[stream] = (max(int(times[places].max()), state.getCurrentWatermarkMs()) + IDLE_MS, *entry)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text", "outcome", "guardrail", "reason", "check_due"])
    set_alarm(state, known, seen)


def guard_stream(chunks: DataFrame, policies: DataFrame, vault: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Released text and outcome of live chunks (stream_id, tenant_id, seq, ts, delta, closes, finished).

    ``vault`` is a table with one row per stream and a map ``vault`` of token to value, or a second stream of
    rows (stream_id, ts, token, value).  Live rows are kept with their stream's state, so they may come at any
    time up to the micro-batch of the first chunk that names them, and go when the stream has been idle
    for an hour.  Either way a stream's vault is its request's own, as small as the request.
    Chunks of a stream arrive in order.
    """
    out = F.col("output")
    rules = policies.select("tenant_id", out["max_length"].alias("max_length"),
                            (out["toxicity"]["enabled"] & (out["toxicity"]["provider"] == "wordlist")).alias("words"),
                            (out["toxicity"]["enabled"] & out["toxicity"]["provider"].isin("openai", "perspective")).alias("scored"))
    d = chunks.withColumn("stream_id", F.col("stream_id").cast("string"))
    none = F.lit(None).cast("string")
    if vault.isStreaming:
        known = vault.select(F.col("stream_id").cast("string").alias("stream_id"), "ts", "token", "value", F.lit(False).alias("is_chunk"))
        d = d.withColumns({"is_chunk": F.lit(True), "token": none, "value": none}).unionByName(known, allowMissingColumns=True)
        d = d.withColumn("vault", none)
    else:
        d = d.withColumns({"is_chunk": F.lit(True), "token": none, "value": none}).join(
            vault.select(F.col("stream_id").cast("string").alias("stream_id"), F.to_json("vault").alias("vault")), "stream_id", "left")
    d = lookup(d.withWatermark("ts", delay), rules, ["tenant_id"])
    d = d.select("stream_id", "seq", "delta", "closes", "finished", "max_length", "words", "scored", "is_chunk", "token", "value",
                 "vault", F.unix_millis("ts").alias("ms"), "ts")
    return d.withColumn("bucket", bucket("stream_id")).groupBy("bucket").applyInPandasWithState(
        _advance, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
