"""Live streams kept in buckets, micro-batches of several files, and state over as many partitions as cores."""

import os

import pandas as pd
from pyspark.sql import functions as F

from parapet.plans import datasets as ds
from parapet.plans import registry
from parapet.streaming import guard, lines
from tests.test_live_state import State, batch, chunk, vault_row


def lines_of(*rows):
    return pd.DataFrame(rows, columns=["stream_id", "seq", "line", "ms"])


def passed(advance, state, *batches):
    return [r for b in batches for frame in advance((7,), [b], state) for r in frame.itertuples(index=False, name=None)]


def test_streams_of_a_bucket_are_decoded_apart():
    state = State()
    first = lines_of(("b", 0, "event: two", 0), ("a", 1, "data: {1}", 0), ("a", 0, "event: one", 0), (None, 0, "event: none", 0))
    later = lines_of((None, 1, "data: {3}", 9), ("b", 1, "data: {2}", 9), ("a", 2, "", 9), ("c", 0, "data: {4}", 9))
    got = passed(lines._advance(False), state, first, later)
    assert {(r[0], r[1], r[3]) for r in got} == {("a", 0, "one"), ("a", 1, "one"), ("b", 0, "two"), (None, 0, "none"), (None, 1, "none"),
                                                 ("b", 1, "two"), ("a", 2, ""), ("c", 0, "")}
    # each stream goes an hour after its own last line, and the bucket with the last of them
    state.watermark = 3_600_001
    assert passed(lines._advance(False), state, lines_of(("b", 2, "x", 3_600_001))) == [("b", 2, "x", "two")]
    assert set(state.get[0]) == {None, "a", "b", "c"}
    state.watermark, state.hasTimedOut = 3_600_010, True
    assert passed(lines._advance(False), state, None) == [] and state.get[0] == ["b"]
    assert state.timeout == 7_200_001
    state.watermark = 7_200_002
    assert passed(lines._advance(False), state, None) == [] and not state.exists


def test_streams_of_a_bucket_are_guarded_apart():
    rows = [chunk(0, "to [PII_EM") | {"stream_id": "a"}, chunk(0, "go ") | {"stream_id": "b"}, vault_row("[PII_EMAIL_1]", "a@b.org") | {"stream_id": "a"}]
    more = [chunk(1, "die ", True, True) | {"stream_id": "b"}, chunk(1, "AIL_1]", True, True) | {"stream_id": "a"}]
    got = passed(guard._advance, State(), batch(*rows), batch(*more))
    assert "".join(r[2] for r in got if r[0] == "a") == "to a@b.org"
    assert [(r[2], r[3], r[4]) for r in got if r[0] == "b"] == [("go ", None, None), ("", "output_blocked", "toxicity")]


def test_batches_and_state_follow_rows_and_cores(spark, monkeypatch):
    d = spark.range(40).select(F.col("id").alias("stream_id"), F.concat(F.lit("t"), F.col("id") % 4).alias("tenant_id"),
                               F.repeat(F.lit("some text [x] "), 40).alias("text"), F.lit(True).alias("finished"))
    kept = []
    monkeypatch.setattr(registry, "LIVE_ROWS", 10)
    monkeypatch.setattr(registry, "remove", lambda spark, *paths: kept.extend(paths))
    monkeypatch.setattr(ds, "chunks", lambda spark, sf: ds.sliced(d, ["stream_id", "tenant_id"]))
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {tuple(r) for r in registry.sse_openai_live(spark, "").collect()}
        assert spark.conf.get("spark.sql.shuffle.partitions") == "23"
        assert got == {tuple(r) for r in registry.sse_openai(spark, "").collect()} and len(got) > 600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    state = next(p for p in kept if "live-state" in p)
    # some eighty files
    batches = [f for f in os.listdir(f"{state}/commits") if f.isdigit()]
    assert 8 <= len(batches) <= 14
    assert len([f for f in os.listdir(f"{state}/state/0") if f.isdigit()]) <= spark.sparkContext.defaultParallelism
