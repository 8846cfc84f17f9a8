"""Server-sent-event lines (stream_id, seq, line) parsed to text deltas.

Both shapes give rows ``stream_id, seq, delta, closes, finished``: ``closes`` marks
where held-back text is flushed, ``finished`` where the stream ended properly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.checks import parsed_json
from parapet.operators.scan import running

BLOCK_LINES = 4096


def _text(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))


def _kept(lines: DataFrame, *more: str) -> list[str]:
    return [c for c in lines.columns if c not in ("stream_id", "seq", "line", *more)]


def openai_rows(lines: DataFrame) -> DataFrame:
    """Deltas of ``data:`` lines that come no later than their stream's end mark."""
    d = lines.where(F.startswith("line", F.lit("data: "))).withColumn("__body", F.substr("line", F.lit(7)))
    d = d.withColumn("__chunk", parsed_json(F.when(F.col("__body") != "[DONE]", F.col("__body")))).withColumn(
        "finished", F.col("__body") == "[DONE]")
    ends = F.coalesce(_text(F.col("__chunk"), "$.choices[0].finish_reason") != "", F.lit(False))
    return d.select("stream_id", "seq", *_kept(lines), _text(F.col("__chunk"), "$.choices[0].delta.content").alias("delta"),
                    (F.col("finished") | ends).alias("closes"), "finished")


def openai_deltas(lines: DataFrame) -> DataFrame:
    """``data:`` lines up to the first ``[DONE]``; an empty choice list is an empty delta."""
    # streams with an end mark are few values; a stream's lines are never gathered
    done = lines.where(F.col("line") == "data: [DONE]").groupBy("stream_id").agg(F.min("seq").alias("__done"))
    rows = lines.join(done, "stream_id", "left").where(F.col("__done").isNull() | (F.col("seq") <= F.col("__done"))).drop("__done")
    return openai_rows(rows)


def named_event(line: Column) -> Column:
    """Event that a line names; empty for a blank line, which ends the one before; null for others."""
    return F.when(F.startswith(line, F.lit("event: ")), F.substr(line, F.lit(8))).when(line == "", F.lit(""))


def anthropic_rows(lines: DataFrame, event: str) -> DataFrame:
    """Deltas of ``data:`` lines by the event in force, a column of the lines, and stops of content blocks."""
    is_data = F.startswith("line", F.lit("data: "))
    stop = F.coalesce(named_event(F.col("line")) == "content_block_stop", F.lit(False))
    now = F.col(event)
    chunk = parsed_json(F.when(is_data & (now == "content_block_delta"), F.substr("line", F.lit(7))))
    delta = F.when(_text(F.col("__chunk"), "$.delta.type") == "text_delta", _text(F.col("__chunk"), "$.delta.text")).otherwise("")
    return lines.where(is_data | stop).withColumn("__chunk", chunk).select(
        "stream_id", "seq", *_kept(lines, event), delta.alias("delta"), stop.alias("closes"),
        (is_data & F.coalesce(now == "message_stop", F.lit(False))).alias("finished"))


def anthropic_deltas(lines: DataFrame) -> DataFrame:
    """``event:`` lines name the ``data:`` lines after them, until a blank line."""
    event = named_event(F.col("line"))
    d = running(lines, ["stream_id"], ["seq"], F.floor(F.col("seq") / BLOCK_LINES),
                maxes={"__now": F.when(event.isNotNull(), F.struct("seq", event.alias("name")))})
    return anthropic_rows(d.withColumn("__now", F.col("__now.name")), "__now")
