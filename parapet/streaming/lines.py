"""Server-sent-event lines decoded live, with what a stream's earlier lines said kept as its state.

The state only says which event is in force and whether the stream is over; bodies are
parsed by the same expressions as recorded lines.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from parapet.sources import sse
from parapet.streaming.buckets import IDLE_MS, bucket, set_alarm, streams_of

OUT = "stream_id string, seq long, line string, event string"
STATE = "streams array<string>, last array<bigint>, events array<string>, done array<boolean>"
END = "data: [DONE]"


def _advance(ends: bool) -> Callable:
    def run(key, batches, state):
        seen = {}
        known = {s: (last, event, done) for s, last, event, done in zip(*state.get)} if state.exists else {}
        if not state.hasTimedOut:
            pdf = pd.concat(list(batches))
            seqs, texts, times = (pdf[c].to_numpy(object) for c in ("seq", "line", "ms"))
            ids, kept_seqs, kept, events = [], [], [], []
            for stream, rows in streams_of(pdf, key, ["seq"]):
                _, event, done = known.pop(stream, (0, "", False))
                for line, i in zip(texts[rows].tolist(), rows.tolist()):
                    if done:
                        break
                    if line is None:
                        continue
                    if line.startswith("event: "):
                        event = line[7:]
                    elif line == "":
                        event = ""
                    ids.append(stream)
                    kept_seqs.append(seqs[i])
                    kept.append(line)
                    events.append(event)
                    done = ends and line == END
                # an idle stream is dropped an hour after its last line
                seen[stream] = (max(int(times[rows].max()), state.getCurrentWatermarkMs()) + IDLE_MS, event, done)
            yield pd.DataFrame({"stream_id": ids, "seq": kept_seqs, "line": kept, "event": events})
        set_alarm(state, known, seen)
    return run


def _decoded(lines: DataFrame, delay: str, ends: bool) -> DataFrame:
    d = lines.withWatermark("ts", delay).select(
        F.col("stream_id").cast("string").alias("stream_id"), "seq", "line", F.unix_millis("ts").alias("ms"), "ts")
    return d.withColumn("bucket", bucket("stream_id")).groupBy("bucket").applyInPandasWithState(_advance(ends), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def openai_stream(lines: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Deltas of live lines (stream_id, seq, ts, line); nothing counts after a stream's end mark."""
    return sse.openai_rows(_decoded(lines, delay, True).drop("event"))


def anthropic_stream(lines: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Deltas of live lines (stream_id, seq, ts, line); an ``event:`` line may come a micro-batch before its ``data:`` line."""
    return sse.anthropic_rows(_decoded(lines, delay, False), "event")
