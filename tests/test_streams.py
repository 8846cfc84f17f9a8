"""Recorded and live response streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parapet import fixed_values as fv
from parapet.operators import chunks, limits, policy
from parapet.sources import config, sse, tables
from parapet.streaming import guard, limiter, rollup

CONFIG = {"tenants": {"default": {"output": {"max_length": 200}}, "long": {"output": {}},
                      "model": {"output": {"toxicity": {"provider": "openai"}}}}}


@pytest.fixture(scope="module")
def policies(spark):
    d = policy.resolve_policies(spark.createDataFrame([("default",), ("long",), ("model",)], "tenant_id string"),
                                config.policies_from_dict(spark, CONFIG)).cache()
    d.count()
    return d


def frame(spark, streams, tenant="long"):
    rows = []
    for sid, deltas in streams.items():
        for i, d in enumerate(deltas):
            rows.append((sid, tenant, i, d, False, False))
        rows.append((sid, tenant, len(deltas), "", True, True))
    return spark.createDataFrame(rows, "stream_id string, tenant_id string, seq long, delta string, closes boolean, finished boolean")


def pieces(text, rng):
    out = []
    while text:
        n = rng.choice([1, 1, 2, 3, 5, 9, 20])
        out.append(text[:n])
        text = text[n:]
    return out


def texts(n, seed):
    rng = random.Random(seed)
    bits = ["mail ", "[PII_EMAIL_1]", "[PII_EMAIL_2]", "[PII_", "[P", "[", "]", "kys", "go die", "go ", "die", "x", " ", "[PII_EMAIL_1", "\n", "[0, 1]", "lorem ipsum dolor "]
    return {f"s{i}": pieces("".join(rng.choice(bits) for _ in range(rng.randint(1, 30))), rng) for i in range(n)}


def small_blocks(monkeypatch):
    monkeypatch.setattr(chunks, "BLOCK_ROWS", 7)


def test_words_seen_at_the_right_delta(spark, policies, monkeypatch):
    small_blocks(monkeypatch)
    streams = texts(150, 3)
    got = {r.stream_id: r.seq for r in chunks.word_violations(frame(spark, streams), policies).collect()}
    for sid, deltas in streams.items():
        prefix, want = "", None
        for i, d in enumerate(deltas):
            prefix += d
            if any(re.search(p, prefix, re.I) for p in fv.TOXICITY_PATTERNS):
                want = i
                break
        assert got.get(sid) == want, deltas


def test_length_and_outcome_order(spark, policies):
    streams = {"a": ["x" * 150, "y" * 49, "go die now!"], "b": ["go ", "die", "more"], "c": ["fine"], "d": ["z" * 201]}
    got = {r.stream_id: r for r in chunks.stream_outcomes(frame(spark, streams, "default"), policies).collect()}
    assert (got["a"].guardrail, got["a"].reason, got["a"].cut_seq) == ("output_validator", "Response exceeds max length (210 > 200 chars)", 2)
    assert (got["b"].guardrail, got["b"].cut_seq) == ("toxicity", 1)
    assert got["c"].outcome == "passed" and got["d"].cut_seq == 0
    kept = chunks.delivered(frame(spark, streams, "default"), chunks.stream_outcomes(frame(spark, streams, "default"), policies))
    assert kept.where("stream_id = 'b'").count() == 1


def test_checks_share_one_pass_over_the_chunks(spark, policies, monkeypatch):
    calls, lengths = [], chunks.prefix_lengths
    monkeypatch.setattr(chunks, "prefix_lengths", lambda d: calls.append(d) or lengths(d))
    streams = {"a": ["x" * 600, "fine"], "b": ["go", " d", "ie", "more"], "c": ["ï go ", "dİe go die"], "d": ["kys"], "e": ["xky", "s"]}
    d = frame(spark, streams, "long").where("stream_id <> 'a'").unionByName(frame(spark, {"a": streams["a"]}, "model"))
    scores = spark.createDataFrame([("a", 0, True, {"harm": True}, 0.9)], "stream_id string, seq long, flagged boolean, categories map<string,boolean>, score double")
    got = {r.stream_id: (r.guardrail, r.cut_seq) for r in chunks.stream_outcomes(d, policies, scores).collect()}
    assert got == {"a": ("toxicity", 0), "b": ("toxicity", 2), "c": ("toxicity", 1), "d": ("toxicity", 0), "e": (None, None)}
    assert len(calls) == 1


def test_restored_text_and_holding(spark, monkeypatch):
    small_blocks(monkeypatch)
    streams = texts(150, 5)
    streams["chars"] = list("to [PII_EMAIL_1].")
    vault = spark.createDataFrame([(s, "[PII_EMAIL_1]", "alice@example.com") for s in streams], "request_id string, token string, value string")
    rows = chunks.restore_stream(frame(spark, streams), vault).collect()
    for sid, deltas in streams.items():
        mine = sorted((r.seq, r.delta, r.flushed) for r in rows if r.stream_id == sid)
        whole = "".join(d + f for _, d, f in mine)
        assert whole == "".join(deltas).replace("[PII_EMAIL_1]", "alice@example.com")
        sent = ""
        for (seq, delta, flushed), n in zip(mine, range(len(mine))):
            sent += delta
            prefix = "".join(deltas[:seq + 1])
            held = re.search(fv.PARTIAL_TOKEN_PATTERN + "$", prefix)
            ready = prefix[:held.start()] if held else prefix
            assert sent == ready.replace("[PII_EMAIL_1]", "alice@example.com")


def test_streams_spread_over_ranges_are_restored(spark, monkeypatch):
    """Few streams over many ranges: text before a range, tokens over its edge, closes that come after it."""
    rng = random.Random(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows, want = [], {}
        for s in range(4):
            part, out, seq = "", "", 0
            for i in range(rng.choice([3, 40, 90])):
                piece = rng.choice(["[PII_", "EMAIL_1]", "[PII_EMAIL_", "1", "]", "x ", "[", "y" * 70])
                close = rng.random() < 0.1
                rows += [(f"s{s}", seq, piece, False)] + [(f"s{s}", seq + 1 + k, "", False) for k in range(rng.choice([0, 0, 3]))]
                seq += 5
                part += piece
                if close:
                    rows.append((f"s{s}", seq, "", True))
                    seq += 1
                    out, part = out + part.replace("[PII_EMAIL_1]", "a@b.org"), ""
            rows.append((f"s{s}", seq, "", True))
            want[f"s{s}"] = out + part.replace("[PII_EMAIL_1]", "a@b.org")
        d = spark.createDataFrame(rows, "stream_id string, seq long, delta string, closes boolean")
        vault = spark.createDataFrame([(s, "[PII_EMAIL_1]", "a@b.org") for s in want if s != "s2"], "request_id string, token string, value string")
        got = chunks.restore_stream(d, vault).collect()
        for s, whole in want.items():
            mine = "".join(x.delta + x.flushed for x in sorted((r for r in got if r.stream_id == s), key=lambda r: r.seq))
            assert mine == (whole if s != "s2" else "".join(x[2] for x in rows if x[0] == "s2"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_check_points_in_blocks(spark):
    rng = random.Random(1)
    streams = {f"s{i}": ["x" * rng.choice([1, 40, 300, 700]) for _ in range(60)] for i in range(5)}
    want = set()
    for sid, deltas in streams.items():
        total = last = 0
        for i, d in enumerate(deltas):
            total += len(d)
            if total - last >= 500:
                last = total
                want.add((sid, i, total))
    for size in (1000, 13):
        got = {tuple(r) for r in chunks.check_points(frame(spark, streams), block_rows=size).collect()}
        assert got == want


def test_event_lines(spark, monkeypatch):
    monkeypatch.setattr(sse, "BLOCK_LINES", 2)
    a = ['data: {"choices":[{"delta":{"content":"Hel"}}]}', "", ": ping", 'data: {"choices":[]}', "data: {oops", 'data: {"choices":[{"delta":{"content":"lo"},"finish_reason":"stop"}]}',
         "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}']
    b = ["event: content_block_delta", 'data: {"delta":{"type":"text_delta","text":"Hi"}}', "", 'data: {"delta":{"type":"text_delta","text":"no event"}}',
         "event: content_block_delta", 'data: {"delta":{"type":"input_json_delta","text":"x"}}', "event: content_block_stop", "data: {}", "", "event: message_stop", "data: {}"]
    def lines(x):
        return spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "stream_id string, seq long, line string")
    got = sorted(tuple(r)[1:] for r in sse.openai_deltas(lines(a)).collect())
    assert got == [(0, "Hel", False, False), (3, "", False, False), (4, "", False, False), (5, "lo", True, False), (6, "", True, True)]
    got = sorted(tuple(r)[1:] for r in sse.anthropic_deltas(lines(b)).collect())
    assert [(s, d) for s, d, _, _ in got if d] == [(1, "Hi")] and [s for s, _, c, _ in got if c] == [6] and [s for s, _, _, f in got if f] == [10]


def live(spark, df, tmp_path, build, files=3):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    # one file after the other, so that files arrive in time order
    lo, hi = df.agg(F.min("ts"), F.max("ts")).first()
    for i in range(files):
        since, until = lo + (hi - lo) / files * i, lo + (hi - lo) / files * (i + 1)
        last = F.col("ts") <= until if i == files - 1 else F.col("ts") < until
        df.where((F.col("ts") >= since) & last).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.parquet(out)


def test_live_limiter_equals_batch(spark, tmp_path):
    rng, at, rows = random.Random(4), 1_704_067_200_000_000, []
    for i in range(400):
        at += rng.choice([1_000_000, 15_000_000, 30_000_000, 400_000_000])
        rows.append((i, at, rng.choice("ab")))
    r = spark.createDataFrame(rows, "request_id long, at long, tenant_id string").select("request_id", F.timestamp_micros("at").alias("ts"), "tenant_id")
    lim = spark.createDataFrame([("a", True, 2, 20), ("b", True, None, 9)], "tenant_id string, enabled boolean, requests_per_minute int, requests_per_hour int")
    got = live(spark, r, tmp_path, lambda s: limiter.rate_limit_stream(s, lim))
    want = {x.request_id: (x.limited, x.reason, x.retry_after) for x in limits.rate_limit(r, lim).collect()}
    have = {int(x.request_id): (x.limited, x.reason, x.retry_after) for x in got.collect()}
    assert have == want


def test_live_guard_equals_batch(spark, policies, tmp_path):
    streams = texts(25, 9)
    d = frame(spark, streams, "default")
    d = d.withColumn("ts", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("seq") * 1_000_000))
    tokens = spark.createDataFrame([(s, {"[PII_EMAIL_1]": "alice@example.com"}) for s in streams], "stream_id string, vault map<string,string>")
    got = live(spark, d, tmp_path, lambda s: guard.guard_stream(s, policies, tokens), files=2).collect()
    outcomes = {r.stream_id: r for r in chunks.stream_outcomes(d.drop("ts"), policies).collect()}
    vault = spark.createDataFrame([(s, "[PII_EMAIL_1]", "alice@example.com") for s in streams], "request_id string, token string, value string")
    batch = chunks.restore_stream(chunks.delivered(d.drop("ts"), chunks.stream_outcomes(d.drop("ts"), policies)), vault).collect()
    for sid in streams:
        mine = [r for r in got if r.stream_id == sid]
        assert [(r.outcome, r.guardrail, r.reason) for r in mine if r.outcome] == [(outcomes[sid].outcome, outcomes[sid].guardrail, outcomes[sid].reason)]
        sent = "".join(r.text for r in sorted(mine, key=lambda r: r.seq))
        assert sent == "".join(r.delta + r.flushed for r in sorted((r for r in batch if r.stream_id == sid), key=lambda r: r.seq))


def test_live_rollup_and_audit_sink(spark, tmp_path):
    rows = [(i, 1_704_067_200_000_000 + i * 9_000_000, "ab"[i % 2], "passed" if i % 3 else "input_blocked") for i in range(300)]
    d = spark.createDataFrame(rows, "id long, at long, tenant_id string, outcome string").select("id", F.timestamp_micros("at").alias("ts"), "tenant_id", "outcome")
    got = live(spark, d, tmp_path, rollup.audit_rollup)
    from parapet.operators.audit import audit_by_minute
    want = {tuple(r) for r in audit_by_minute(d).collect()}
    have = {tuple(r) for r in got.collect()}
    assert have and have <= want
    path = str(tmp_path / "log")
    tables.write_audit(d, path)
    tables.write_audit(d.withColumn("prompt_tokens", F.lit(1)).withColumn("api", F.lit("anthropic")), path)
    log = tables.read_audit(spark, path)
    assert log.count() == 600 and {r.api for r in log.select("api").distinct().collect()} == {"openai", "anthropic"}
