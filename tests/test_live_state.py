"""What live operators keep between micro-batches, batch by batch, and the audit log's batches."""

import pandas as pd
from pyspark.sql import functions as F

from parapet.operators import audit
from parapet.sources import tables
from parapet.streaming import guard, lines, rollup


class State:
    """A group's state as the engine hands it over."""

    hasTimedOut = False

    def __init__(self, watermark=0):
        self.value, self.watermark = None, watermark

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def fed(advance, state, *batches):
    out = []
    for b in batches:
        for frame in advance(("s",), [b], state):
            out += frame.itertuples(index=False, name=None)
    return out


def line_batches(text, cut):
    rows = pd.DataFrame({"seq": range(len(text)), "line": text, "ms": 0})
    return [rows.iloc[lo:lo + cut] for lo in range(0, len(rows), cut)]


def test_an_event_names_data_lines_of_later_batches():
    text = ["event: content_block_delta", "data: {1}", "", "data: {2}", "event: content_block_stop", "data: {3}", "event: message_stop", None, "data: {4}"]
    want = [(0, "content_block_delta"), (1, "content_block_delta"), (2, ""), (3, ""), (4, "content_block_stop"), (5, "content_block_stop"),
            (6, "message_stop"), (8, "message_stop")]
    for cut in (1, 2, 3, 20):
        assert [(r[1], r[3]) for r in fed(lines._advance(False), State(), *line_batches(text, cut))] == want


def test_nothing_counts_after_the_end_mark():
    text = ["data: {1}", "data: [DONE]", "data: {2}", "data: [DONE]"]
    for cut in (1, 2, 4):
        assert [r[1] for r in fed(lines._advance(True), State(), *line_batches(text, cut))] == [0, 1]


def chunk(seq, delta, closes=False, finished=False):
    return {"seq": seq, "delta": delta, "closes": closes, "finished": finished, "max_length": None, "words": True, "scored": False,
            "is_chunk": True, "token": None, "value": None, "vault": None, "ms": seq}


def vault_row(token, value):
    return chunk(None, None) | {"is_chunk": False, "token": token, "value": value, "ms": 0}


def batch(*rows):
    d = pd.DataFrame(list(rows))
    return d.astype({"token": object, "value": object, "vault": object, "delta": object}).where(d.notna(), None)


def test_a_vault_that_comes_between_chunks():
    first = batch(vault_row("[PII_EMAIL_1]", "a@b.org"))
    chunks = [batch(chunk(0, "to [PII_EM")), batch(chunk(1, "AIL_1] and [PII_EMAIL_2]")), batch(vault_row("[PII_EMAIL_2]", "c@d.org"), chunk(2, " then [PII_EMAIL_2]")),
              batch(chunk(3, "", True, True))]
    out = fed(guard._advance, State(), first, *chunks)
    assert "".join(r[2] for r in out) == "to a@b.org and [PII_EMAIL_2] then c@d.org" and out[-1][3] == "passed"
    # without a vault nothing is held
    out = fed(guard._advance, State(), *chunks[:1])
    assert [r[2] for r in out] == ["to [PII_EM"]
    # a row of the same micro-batch is known before its chunks
    out = fed(guard._advance, State(), batch(chunk(0, "[PII_EMAIL_1]", True, True), vault_row("[PII_EMAIL_1]", "x")))
    assert out[0][2] == "x"


def test_rows_behind_the_watermark_are_counted_apart():
    d = pd.DataFrame({"tenant_id": "t", "outcome": ["a", "a", "b", "a"], "minute": [1, 1, 1, 2], "end_ms": [60, 60, 60, 120]})
    assert fed(rollup._late, State(watermark=60), d) == [("s", 1, "a", 2), ("s", 1, "b", 1)]
    assert fed(rollup._late, State(watermark=59), d) == []


def entries(spark, ids, **more):
    d = spark.createDataFrame([(f"r{i}", 1_704_067_200 + i, "t", "openai", "passed") for i in ids], "request_id string, ts long, tenant_id string, api string, outcome string")
    d = d.withColumn("ts", F.timestamp_seconds("ts"))
    return d.withColumns({k: F.lit(v) for k, v in more.items()})


def test_batches_of_the_log_count_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert tables.read_audit(spark, path).collect() == [] and tables.next_batch(spark, path) == 0
    tables.write_audit(entries(spark, [3, 1, 2]), path)
    bad = entries(spark, [6, 5]).withColumn("outcome", F.when(F.col("request_id") == "r5", "odd").otherwise(F.col("outcome")))
    tables.write_audit(bad.unionByName(entries(spark, [4], tenant_id=None)), path)
    tables.write_audit(entries(spark, [9, 7, 8], reason="late column"), path)

    def state():
        return ({r["request_id"]: r["id"] for r in tables.read_audit(spark, path).collect()},
                {r["request_id"]: (r["id"], r["fault"]) for r in tables.read_set_aside(spark, path).collect()})

    want = ({"r1": 1, "r2": 2, "r3": 3, "r6": 6, "r7": 7, "r8": 8, "r9": 9}, {"r4": (4, "no tenant"), "r5": (5, "unknown outcome")})
    assert state() == want
    # a replay replaces its own batch, and nothing else
    tables.write_audit(entries(spark, [3, 1, 2]), path, 0)
    tables.write_audit(entries(spark, [7, 8, 9], reason="late column"), path, 2)
    assert state() == want and tables.next_batch(spark, path) == 3
    assert [r["request_id"] for r in audit.recent_audit(tables.read_audit(spark, path), 3).collect()] == ["r9", "r8", "r7"]


def test_a_batch_without_its_size_is_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.write_audit(entries(spark, [1]), path)
    broken = entries(spark, [2]).withColumns({"id": F.lit(2).cast("long"), "batch": F.lit(1), "dt": F.to_date("ts")})
    broken.write.mode("append").partitionBy("dt", "batch").parquet(f"{path}/log")
    assert [r["request_id"] for r in tables.read_audit(spark, path).collect()] == ["r1"]
