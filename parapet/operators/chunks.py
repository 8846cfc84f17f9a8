"""Checks and restoring over recorded response streams.

Rows are ``stream_id, seq, delta, closes, finished`` (see ``sources.sse``) with the
tenant's ``tenant_id``.  Prefixes are never built: each row carries its running
length and the few characters before it that a match could reach back to.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet import fixed_values as fv
from parapet.functions import checks, patterns, pii
from parapet.operators.scan import preceding_text, running
from parapet.operators.verdicts import with_policy
from parapet.storage import written

BLOCK_ROWS = 4096
# Held text of a live stream never needs to be longer than its longest token.
LONGEST_TOKEN = 64
MODELS = ("openai", "perspective")


def prefix_lengths(chunks: DataFrame) -> DataFrame:
    """Non-empty deltas with their rank and the text length up to and including them."""
    d = chunks.where(F.col("delta") != "")
    return running(d, ["stream_id"], ["seq"], F.floor(F.col("seq") / BLOCK_ROWS),
                   sums={"rank": F.lit(1), "total": F.length("delta")})


def length_violations(chunks: DataFrame, policies: DataFrame) -> DataFrame:
    """First delta at which a stream is longer than its tenant allows."""
    return _over_length(prefix_lengths(chunks), policies)


def _over_length(lengths: DataFrame, policies: DataFrame) -> DataFrame:
    d = with_policy(lengths, policies, "output")
    limit = F.col("output.max_length")
    over = d.where((limit != 0) & (F.col("total") > limit))
    reason = F.concat(F.lit("Response exceeds max length ("), F.col("total").cast("string"), F.lit(" > "),
                      limit.cast("string"), F.lit(" chars)"))
    return over.groupBy("stream_id").agg(F.min(F.struct("seq", reason.alias("reason"))).alias("x")).select(
        "stream_id", "x.*")


def word_violations(chunks: DataFrame, policies: DataFrame) -> DataFrame:
    """First delta at which the text so far holds a listed word.

    A match in a prefix that was not in the prefix before must end in the new
    delta, so the delta and a few characters before it are enough.
    """
    return _listed_words(prefix_lengths(_checked_by(chunks, policies, "wordlist").select("stream_id", "seq", "delta")))


def _checked_by(rows: DataFrame, policies: DataFrame, *providers: str) -> DataFrame:
    """Rows whose tenant has its streams checked by one of the providers."""
    tox = F.col("output.toxicity")
    return with_policy(rows, policies, "output").where(tox["enabled"] & tox["provider"].isin(*providers))


def _listed_words(lengths: DataFrame) -> DataFrame:
    width = fv.TOXICITY_LONGEST_MATCH + 1
    d = preceding_text(lengths.select("stream_id", "seq", "delta", "rank"), ["stream_id"], "rank",
                       F.col("delta"), width, "before")
    text = F.concat(F.when(F.length("before") < width, " ").otherwise(""), F.col("before"), F.col("delta"))
    found = F.lit(False)
    for pattern in fv.TOXICITY_PATTERNS:
        # a match cannot start at the cut edge, where the character before is unknown
        body = patterns.exact(pattern, word_edges=True)
        found = found | F.rlike(text, F.lit("(?isu)(?<=.)" + body))
    return d.where(found).groupBy("stream_id").agg(F.min("seq").alias("seq")).withColumn(
        "reason", F.lit("Response contains toxic content"))


def _leap(totals: np.ndarray, last: np.ndarray, every: int) -> np.ndarray:
    """Place of the first total that has grown by ``every`` since each of ``last``."""
    return np.searchsorted(totals, last + every)


def _exits(before: int, totals: np.ndarray, every: int) -> np.ndarray:
    """For a block of deltas, how far behind its end the last check is, by how far behind its start it was.

    The text cannot have grown by ``every`` since the last check, or the start would be one,
    so ``every`` entries tell all there is to know about a block.
    """
    last = before - np.arange(every)
    on = np.arange(every)
    while len(on):
        at = _leap(totals, last[on], every)
        on, at = on[at < len(totals)], at[at < len(totals)]
        last[on] = totals[at]
    return totals[-1] - last


def _check_tables(every: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("total")
        totals = rows["total"].to_numpy(np.int64)
        table = _exits(int(totals[0] - rows["size"].iloc[0]), totals, every)
        return pd.DataFrame({"stream_id": [key[0]], "block": [key[1]], "exits": [table.astype("<i4").tobytes()]})
    return run


def _check_entries(batches):
    """Entry of every block of a stream, from the exits of the blocks before it, in order."""
    stream, behind = None, 0
    for pdf in batches:
        entries = []
        for s, exits in zip(pdf["stream_id"], pdf["exits"]):
            if s != stream:
                stream, behind = s, 0
            entries.append(behind)
            behind = int(np.frombuffer(exits, dtype="<i4")[behind])
        yield pdf[["stream_id", "block"]].assign(behind=entries)


def _check_picks(every: int):
    def run(batches):
        """Rows of (stream, block) in order, the first of each telling where the last check was."""
        key, last = None, 0
        for pdf in batches:
            stream, block = pdf["stream_id"].to_numpy(object), pdf["block"].to_numpy(np.int64)
            totals, sizes, behind = (pdf[c].to_numpy(np.int64) for c in ("total", "size", "behind"))
            starts = np.flatnonzero(np.r_[True, (stream[1:] != stream[:-1]) | (block[1:] != block[:-1])]) if len(pdf) else []
            picked = []
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                if (stream[lo], block[lo]) != key:
                    key, last = (stream[lo], block[lo]), totals[lo] - sizes[lo] - behind[lo]
                own = totals[lo:hi]
                while (at := int(_leap(own, last, every))) < len(own):
                    picked.append(lo + at)
                    last = own[at]
            yield pdf[["stream_id", "seq", "total"]].iloc[picked]
    return run


def check_points(chunks: DataFrame, every: int = fv.MODEL_CHECK_INTERVAL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Deltas at which a costly model would score the text so far.

    That is the first delta at which the text has grown by ``every`` characters
    since the last such delta.  Blocks of a stream are looked at side by side: each gives a
    table from how far behind its start the last check may be to the same at its end, tables are
    followed in order (one row per block), and with its entry known each block picks its own rows.
    Streams of one block need no table.
    """
    return _check_points(prefix_lengths(chunks.select("stream_id", "seq", "delta")), every, block_rows)


def _check_points(lengths: DataFrame, every: int, block_rows: int) -> DataFrame:
    id_type = lengths.schema["stream_id"].dataType
    d = lengths.select(
        F.col("stream_id").cast("string").alias("stream_id"), F.floor((F.col("rank") - 1) / block_rows).alias("block"), "seq",
        F.col("total").cast("long").alias("total"), F.length("delta").cast("long").alias("size"))
    # read twice: written once, without the texts
    d = written(d, "lengths")
    long = d.where("block > 0").select("stream_id").distinct()
    tables = d.join(long, "stream_id", "left_semi").groupBy("stream_id", "block").applyInPandas(
        _check_tables(every), "stream_id string, block long, exits binary")
    entries = tables.repartition("stream_id").sortWithinPartitions("stream_id", "block").mapInPandas(
        _check_entries, "stream_id string, block long, behind long")
    keys = ["stream_id", "block"]
    rows = d.join(entries, keys, "left").withColumn("behind", F.coalesce("behind", F.lit(0)))
    out = rows.repartition(*keys).sortWithinPartitions(*keys, "total").mapInPandas(
        _check_picks(every), "stream_id string, seq long, total long")
    return out.select(F.col("stream_id").cast(id_type).alias("stream_id"), "seq", "total")


def model_violations(chunks: DataFrame, policies: DataFrame, scores: DataFrame,
                     every: int = fv.MODEL_CHECK_INTERVAL) -> DataFrame:
    """First check point whose score (stream_id, seq, flagged, categories, score) is over the limit."""
    d = _checked_by(chunks, policies, *MODELS)
    tenants = d.groupBy("stream_id").agg(F.first("tenant_id").alias("tenant_id"))
    return _over_score(prefix_lengths(d.select("stream_id", "seq", "delta")), tenants, policies, scores, every)


def _over_score(lengths: DataFrame, tenants: DataFrame, policies: DataFrame, scores: DataFrame, every: int) -> DataFrame:
    tox = F.col("output.toxicity")
    at = _check_points(lengths, every, BLOCK_ROWS).join(scores, ["stream_id", "seq"]).join(tenants, "stream_id")
    at = with_policy(at, policies, "output")
    # the text up to a check point is never empty
    reason = checks.toxicity_error(F.lit("."), tox["provider"], tox["enabled"], tox["threshold"],
                                   F.col("flagged"), F.col("categories"), F.col("score"))
    return at.withColumn("reason", reason).where(F.col("reason").isNotNull()).groupBy("stream_id").agg(
        F.min(F.struct("seq", "reason")).alias("x")).select("stream_id", "x.*")


def stream_outcomes(chunks: DataFrame, policies: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Outcome of each stream: the first violation, length before toxicity at one delta.

    A stream that neither broke a rule nor ended properly has a null outcome.
    """
    # every check reads the same running lengths
    lengths = written(prefix_lengths(chunks.select("stream_id", "tenant_id", "seq", "delta")), "lengths")
    found = _over_length(lengths, policies).withColumn("rank", F.lit(0))
    found = found.unionByName(_listed_words(_checked_by(lengths, policies, "wordlist")).withColumn("rank", F.lit(1)))
    if scores is not None:
        modelled = _checked_by(lengths, policies, *MODELS)
        tenants = modelled.groupBy("stream_id").agg(F.first("tenant_id").alias("tenant_id"))
        over = _over_score(modelled, tenants, policies, scores, fv.MODEL_CHECK_INTERVAL)
        found = found.unionByName(over.withColumn("rank", F.lit(1)))
    first = found.groupBy("stream_id").agg(F.min(F.struct("seq", "rank", "reason")).alias("v"))
    ends = chunks.groupBy("stream_id").agg(F.first("tenant_id").alias("tenant_id"), F.max("finished").alias("finished"))
    d = ends.join(first, "stream_id", "left")
    return d.select(
        "stream_id", "tenant_id",
        F.when(F.col("v").isNotNull(), "output_blocked").when(F.col("finished"), "passed").alias("outcome"),
        F.when(F.col("v.rank") == 0, "output_validator").when(F.col("v.rank") == 1, "toxicity").alias("guardrail"),
        F.col("v.reason").alias("reason"), F.col("v.seq").alias("cut_seq"))


def delivered(chunks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows a client received: those before the first violation."""
    cuts = outcomes.where(F.col("cut_seq").isNotNull()).select("stream_id", "cut_seq")
    return chunks.join(cuts, "stream_id", "left").where(
        F.col("cut_seq").isNull() | (F.col("seq") < F.col("cut_seq"))).drop("cut_seq")


def partial_token(text: Column, longest: int = LONGEST_TOKEN) -> Column:
    """Length of a trailing piece of text that may still become a token."""
    tail = F.right(text, F.lit(longest))
    found = F.regexp_extract(tail, patterns.exact(fv.PARTIAL_TOKEN_PATTERN) + r"\n?\z", 0)
    return F.when(F.contains(tail, F.lit("[")), F.length(found)).otherwise(0)


MARKS = ("stream_id {id}, seq {seq}, delta string, owned boolean, before string, reaches boolean, last int, range int, "
         "first {id}, first_event int, single boolean")
NOT_LAST, LAST, UNDECIDED = 0, 1, 2
NOTHING, TEXT, CLOSE = 0, 1, 2


def _mark(longest: int, columns: list[str]):
    def run(batches):
        """Text rows of a range with the text before them, and one row that sums the range up.

        ``reaches``: the text before goes back to the range's start, where more may come before it.
        The summary's ``before`` is the text at the range's end, its ``last`` whether a row there is undecided.
        """
        number, out = TaskContext.get().partitionId(), []
        stream = first = held = None
        tail, from_start, started, runs, first_event = "", True, False, 0, NOTHING

        def decide(last: int) -> None:
            nonlocal held
            if held is not None:
                out.append((*held, last, number, None, None, None))
                held = None

        for pdf in batches:
            for s, seq, delta, closes, owned in zip(*[pdf[c].tolist() for c in ("stream_id", "seq", "delta", "closes", "owned")]):
                if not started or s != stream:
                    decide(NOT_LAST)
                    stream, tail, from_start, runs = s, "", not started, runs + 1
                    if not started:
                        first, started = s, True
                if delta:
                    decide(NOT_LAST)
                    if runs == 1 and first_event == NOTHING:
                        first_event = TEXT
                    held = (s, seq, delta, owned, tail if owned else "", from_start and len(tail) < longest)
                    tail = (tail + delta)[-longest:]
                if closes:
                    if runs == 1 and first_event == NOTHING:
                        first_event = CLOSE
                    decide(LAST)
                    tail, from_start = "", False
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if started:
            undecided = held is not None
            decide(UNDECIDED)
            out.append((stream, None, None, None, tail, from_start, UNDECIDED if undecided else NOT_LAST, number, first, first_event, runs == 1))
            yield pd.DataFrame(out, columns=columns)
    return run


def _handed_back(summaries: list, longest: int) -> list[tuple[int, str, bool]]:
    """(range, text before it, whether its undecided row turned out to be the last before a close)."""
    before: dict[int, str] = {}
    closed: dict[int, bool] = {}
    stream, tail, waiting, begun = None, "", None, False
    for r in sorted(summaries, key=lambda r: r["range"]):
        goes_on = begun and r["first"] == stream
        begun = True
        if goes_on:
            before[r["range"]] = tail
            if waiting is not None and r["first_event"] != NOTHING:
                closed[waiting] = r["first_event"] == CLOSE
                waiting = None
        else:
            waiting = None
        undecided = r["last"] == UNDECIDED
        if goes_on and r["single"] and r["reaches"]:
            tail = (tail + r["before"])[-longest:]
            waiting = r["range"] if undecided else waiting
        else:
            stream, tail, waiting = r["stream_id"], r["before"], r["range"] if undecided else None
    return [(n, before.get(n, ""), closed.get(n, False)) for n in before.keys() | closed.keys()]


def restore_stream(chunks: DataFrame, vault: DataFrame) -> DataFrame:
    """Text each delta releases once tokens are put back, and the text flushed at its end.

    A trailing piece that may become a token is held until it is decided; held
    text is flushed where the stream (or its content block) closes.  A stream without
    vault rows has nothing to put back: its deltas pass as they are.

    Chunks are laid out once as ranges of (stream, place).  Inside a range, the few characters before each
    row are carried along; each range leaves one summary row, and what the ranges before
    it hold is handed back to it, so a stream may be spread over any number of tasks.
    """
    spark = chunks.sparkSession
    owners = vault.select(F.col("request_id").alias("stream_id")).distinct().withColumn("owned", F.lit(True))
    longest = max(LONGEST_TOKEN, vault.agg(F.max(F.length("token"))).first()[0] or 0)
    types = {k: chunks.schema[c].dataType.simpleString() for k, c in (("id", "stream_id"), ("seq", "seq"))}
    schema = MARKS.format(**types)
    d = chunks.select("stream_id", "seq", "delta", "closes").join(owners, "stream_id", "left").withColumn("owned", F.coalesce("owned", F.lit(False)))
    columns = [f.split()[0] for f in schema.split(", ")]
    marks = written(d.repartitionByRange("stream_id", "seq").sortWithinPartitions("stream_id", "seq").mapInPandas(
        _mark(longest, columns), schema), "marks")
    # one row and a few characters per range
    back = _handed_back(marks.where("first_event IS NOT NULL").collect(), longest)
    back = F.broadcast(spark.createDataFrame(back, "range int, carried string, closed boolean"))
    # a range may begin in the middle of a stream only
    firsts = F.broadcast(marks.where("first_event IS NOT NULL").select("range", F.col("first").alias("__first")))
    d = marks.where("delta IS NOT NULL").drop("first", "first_event", "single").join(back, "range", "left").join(firsts, "range", "left")
    before = F.when(F.col("reaches") & F.col("owned") & (F.col("stream_id") == F.col("__first")), F.right(
        F.concat(F.coalesce("carried", F.lit("")), F.col("before")), F.lit(longest))).otherwise(F.col("before"))
    is_last = (F.col("last") == LAST) | ((F.col("last") == UNDECIDED) & F.coalesce("closed", F.lit(False)))
    d = d.select("stream_id", "seq", "delta", "owned", before.alias("before"), is_last.alias("is_last"))
    whole = F.concat("before", "delta")
    # a right() of length 0 is empty
    d = d.withColumn("held", F.when(F.col("owned"), partial_token(whole, longest)).otherwise(0)).withColumn(
        "ready", F.concat(F.right("before", F.when(F.col("owned"), partial_token(F.col("before"), longest)).otherwise(0)), F.col("delta")))
    d = d.select("stream_id", "seq", "owned", F.left("ready", F.length("ready") - F.col("held")).alias("delta"),
                 F.when(F.col("is_last"), F.right(whole, F.col("held"))).otherwise("").alias("flushed"))
    both = F.concat("delta", F.lit("\n"), "flushed")
    holds = F.col("owned") & F.contains(both, F.lit("[PII_"))
    named = d.where(holds).select("stream_id", "seq", F.explode(pii.text_tokens(both)).alias("token"))
    known = named.join(vault.select(F.col("request_id").alias("stream_id"), "token", "value"), ["stream_id", "token"]).groupBy(
        "stream_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("__vault"))
    return d.join(known, ["stream_id", "seq"], "left").select(
        "stream_id", "seq", *[F.when(F.col("__vault").isNotNull(), pii.restore_tokens(F.col(c), F.col("__vault"))).otherwise(F.col(c)).alias(c)
                              for c in ("delta", "flushed")])
