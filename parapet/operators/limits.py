"""Sliding-window rate limits and monthly caps over a request log."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.operators.folds import ROWS_PER_SLICE, sliced_fold
from parapet.operators.policy import account_plans
from parapet.operators.scan import lookup, running

MINUTE, HOUR = 60_000_000, 3_600_000_000
SLOT = 10_000_000
SLOTS_PER_MINUTE, SLOTS_PER_HOUR = MINUTE // SLOT, HOUR // SLOT


def _limits(limits: DataFrame) -> DataFrame:
    on = F.coalesce("enabled", F.lit(False))
    return limits.select(
        "tenant_id", F.when(on, F.col("requests_per_minute")).alias("rpm"),
        F.when(on, F.col("requests_per_hour")).alias("rph"))


class Limiter:
    """Allowed request times of one key, in microseconds."""

    def __init__(self, rpm, rph):
        self.windows = [(MINUTE, rpm, "minute"), (HOUR, rph, "hour")]
        self.windows = [(w, int(n), label) for w, n, label in self.windows if n is not None]
        self.kept = [deque() for _ in self.windows]

    def decide(self, now: int):
        """(reason, retry_after) if refused, else (None, None) and the time is recorded."""
        for (width, limit, label), seen in zip(self.windows, self.kept):
            while seen and seen[0] < now - width:
                seen.popleft()
            if len(seen) >= limit:
                wait = (seen[0] + width - now) // 1_000_000 + 1 if seen else width // 1_000_000
                return f"Rate limit exceeded: {limit} requests per {label}", max(1, int(wait))
        for seen in self.kept:
            seen.append(now)
        return None, None

    def record(self, at: int) -> None:
        for seen in self.kept:
            seen.append(at)

    def times(self) -> list[int]:
        """Allowed times that can still matter, oldest first."""
        return list(self.kept[-1]) if self.kept else []


FOLD_SCHEMA = ("tenant_id string, episode long, slice int, carried boolean, hot boolean, at long, request_id {id}, "
               "rpm int, rph int, reason string, retry_after int")
NOBODY = np.iinfo(np.int64).min


class Leaps:
    """The limiter of one key over sorted arrays of times, from one allowed request to the next.

    While a window is full nothing changes until its oldest time has left it, so all
    requests up to there are refused at once: the work is in proportion to allowed requests and
    stretches, not to refused ones.  Allowed times are kept as far as the widest window reaches.
    """

    def __init__(self, rpm: int | None, rph: int | None):
        self.windows = [(w, int(n), label) for w, n, label in ((MINUTE, rpm, "minute"), (HOUR, rph, "hour")) if n is not None]
        self.allowed: list[int] = []

    def record(self, times: list[int]) -> None:
        self.allowed.extend(times)

    def decide(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which window (number, -1: allowed) refuses each request, and its oldest time then (``NOBODY``: limit 0)."""
        by = np.full(len(at), -1, dtype=np.int8)
        oldest = np.full(len(at), NOBODY, dtype=np.int64)
        if not self.windows or not len(at):
            return by, oldest
        kept, i, n = self.allowed, 0, len(at)
        while i < n:
            now, end = int(at[i]), n
            for w, (width, limit, _) in enumerate(self.windows):
                if limit == 0:
                    by[i:n] = w
                    break
                if len(kept) >= limit and kept[-limit] >= now - width:
                    # full until its oldest time is more than a width ago; an earlier window may fill no more in between
                    end = int(np.searchsorted(at, kept[-limit] + width, side="right"))
                    by[i:end], oldest[i:end] = w, kept[-limit]
                    break
            else:
                kept.append(now)
                end = i + 1
            i = max(end, i + 1)
        del kept[:-max(max(limit for _, limit, _ in self.windows), 1)]
        return by, oldest

    def times(self) -> list[int]:
        """Allowed times that can still matter, oldest first."""
        return list(self.allowed)


def _state_rows(key, limiter: Leaps, rpm, rph) -> pd.DataFrame:
    times = limiter.times()
    return pd.DataFrame({
        "tenant_id": key[0], "episode": key[1], "slice": 0, "carried": True, "hot": False, "at": times,
        "request_id": None, "rpm": rpm, "rph": rph, "reason": None, "retry_after": None}, index=range(len(times)))


def _fold(keep_state: bool):
    def fold(batches):
        """Decide rows in order; a change of key starts an empty limiter."""
        key = limiter = rpm = rph = None
        for pdf in batches:
            ended, results = [], []
            at = pdf["at"].to_numpy(np.int64)
            carried = pdf["carried"].to_numpy(bool)
            tenant, episode = pdf["tenant_id"].to_numpy(object), pdf["episode"].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, (tenant[1:] != tenant[:-1]) | (episode[1:] != episode[:-1])]) if len(pdf) else []
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                if (tenant[lo], episode[lo]) != key:
                    if keep_state and key is not None:
                        ended.append(_state_rows(key, limiter, rpm, rph))
                    key = tenant[lo], episode[lo]
                    rpm, rph = (None if pd.isna(v) else int(v) for v in pdf[["rpm", "rph"]].iloc[lo])
                    limiter = Leaps(rpm, rph)
                first = lo + int(carried[lo:hi].sum())
                limiter.record(at[lo:first].tolist())
                by, oldest = limiter.decide(at[first:hi])
                reason, wait = np.full(hi - lo, None, dtype=object), np.full(hi - lo, -1, dtype=np.int64)
                for w, (width, limit, label) in enumerate(limiter.windows):
                    here = np.flatnonzero(by == w)
                    reason[here + first - lo] = f"Rate limit exceeded: {limit} requests per {label}"
                    none = oldest[here] == NOBODY
                    left = np.where(none, 0, oldest[here]) + width - at[first:hi][here]
                    wait[here + first - lo] = np.where(none, width // 1_000_000, np.maximum(1, left // 1_000_000 + 1))
                results.append((reason, wait))
            if results:
                wait = np.concatenate([w for _, w in results])
                out = pdf.assign(reason=np.concatenate([r for r, _ in results]),
                                 retry_after=pd.array(wait, dtype="Int32"))
                out.loc[wait < 0, "retry_after"] = pd.NA
                yield out[~carried]
            yield from ended
        if keep_state and key is not None:
            yield _state_rows(key, limiter, rpm, rph)
    return fold


def busy_slots(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Time slots whose requests need the fold, with their episode.

    From counts per (tenant, 10 seconds) alone: a request whose raw trailing
    counts stay within the limits is allowed whatever happened before, because
    recorded requests are a subset of raw ones.  Slots above a limit are hot; hot
    slots less than one window apart form an episode.  An episode starts one
    quiet window before its first hot slot, where the state is exactly the raw
    requests, so episodes can be folded independently.
    """
    slots = requests.groupBy("tenant_id", F.floor(F.unix_micros("ts") / SLOT).alias("slot")).agg(
        F.count("*").alias("n"))
    d = lookup(slots, limits, ["tenant_id"], "inner").where(F.col("rpm").isNotNull() | F.col("rph").isNotNull())
    w = Window.partitionBy("tenant_id").orderBy("slot")
    per_minute = F.sum("n").over(w.rangeBetween(-SLOTS_PER_MINUTE, 0))
    per_hour = F.sum("n").over(w.rangeBetween(-SLOTS_PER_HOUR, 0))
    hot = F.coalesce(per_minute > F.col("rpm"), F.lit(False)) | F.coalesce(per_hour > F.col("rph"), F.lit(False))
    reach = F.when(F.col("rph").isNotNull(), SLOTS_PER_HOUR).otherwise(SLOTS_PER_MINUTE) + 1
    d = d.withColumn("hot", hot).withColumn("reach", reach)
    hot_slot = F.when(F.col("hot"), F.col("slot"))
    previous = F.last(hot_slot, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("starts", F.col("hot") & F.coalesce(F.col("slot") - previous > F.col("reach"), F.lit(True)))
    start = F.when(F.col("starts"), F.col("slot"))
    d = d.withColumn("open", F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # looking ahead as a running value in reverse order, which stays linear
    ahead = Window.partitionBy("tenant_id").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    next_hot = F.last(F.when(F.col("hot"), F.struct("slot", "open")), ignorenulls=True).over(ahead)
    d = d.withColumn("next", next_hot)
    d = d.where(F.col("next").isNotNull() & (
        (F.col("next.open") <= F.col("slot")) | (F.col("slot") >= F.col("next.open") - F.col("reach"))))
    return d.select("tenant_id", "slot", F.col("next.open").alias("episode"), "hot", "n", "rpm", "rph")


def rate_limit(requests: DataFrame, limits: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Decision of the sliding-window limiter for every request of a log.

    The minute window is tested before the hour window and refused requests are
    not recorded.  Only requests in busy stretches are folded; the rest are
    allowed from counts.
    """
    requests = requests.select("request_id", "ts", "tenant_id")
    busy = busy_slots(requests, _limits(limits))
    per_episode = Window.partitionBy("tenant_id", "episode").orderBy("slot")
    before = F.sum("n").over(per_episode.rowsBetween(Window.unboundedPreceding, -1))
    busy = busy.withColumn("slice", F.floor(F.coalesce(before, F.lit(0)) / rows_per_slice).cast("int"))
    slices = (busy.agg(F.max("slice")).first()[0] or 0) + 1

    d = requests.withColumn("slot", F.floor(F.unix_micros("ts") / SLOT))
    # slots of one tenant spread the rows, so this join has no hot key
    d = d.join(busy, ["tenant_id", "slot"], "left")
    calm = d.where(F.col("hot").isNull() | ~F.col("hot")).select(
        "request_id", "ts", "tenant_id", F.lit(False).alias("limited"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("retry_after"))
    rows = d.where(F.col("hot").isNotNull()).select(
        "tenant_id", "episode", "slice", F.lit(False).alias("carried"), "hot", F.unix_micros("ts").alias("at"),
        "request_id", F.col("rpm").cast("int").alias("rpm"),
        F.col("rph").cast("int").alias("rph"))
    rows = rows.withColumn("reason", F.lit(None).cast("string")).withColumn("retry_after", F.lit(None).cast("int"))
    folded = sliced_fold(rows, ["tenant_id", "episode"], ["at", "request_id"], slices, _fold(slices > 1),
                         FOLD_SCHEMA.format(id=requests.schema["request_id"].dataType.simpleString()))
    # rows of quiet slots only seed an episode; they are among the calm ones already
    decided = folded.where("hot").select(
        "request_id", F.timestamp_micros("at").alias("ts"), "tenant_id",
        F.col("reason").isNotNull().alias("limited"), "reason", "retry_after")
    return calm.unionByName(decided)


def rate_limit_status(decisions: DataFrame, limits: DataFrame, as_of: Column) -> DataFrame:
    """Used and remaining requests of each limited window at a time."""
    at = F.unix_micros(as_of)
    recorded = decisions.where(~F.col("limited") & (F.unix_micros("ts") >= at - HOUR) & (F.col("ts") <= as_of))
    used = recorded.groupBy("tenant_id").agg(
        F.count_if(F.unix_micros("ts") >= at - MINUTE).alias("m"), F.count("*").alias("h"))
    d = lookup(_limits(limits), used, ["tenant_id"])
    rows = d.select("tenant_id", F.explode(F.array(
        F.struct(F.lit("minute").alias("window"), F.col("rpm").alias("limit"), F.coalesce("m", F.lit(0)).alias("used")),
        F.struct(F.lit("hour").alias("window"), F.col("rph").alias("limit"), F.coalesce("h", F.lit(0)).alias("used")),
    )).alias("x")).select("tenant_id", "x.*")
    return rows.where(F.col("limit").isNotNull()).withColumn(
        "remaining", F.greatest(F.lit(0), F.col("limit") - F.col("used")))


def request_rate(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Raw trailing request count of a tenant at each request.

    The count is the difference of two running counts: up to the request's time, and
    before the window's start.  Both are looked up by marker rows in one ordered
    pass over blocks of time, so a busy tenant costs no more per row than a quiet one.
    """
    width = seconds * 1_000_000
    at = F.unix_micros("ts")
    marks = F.array(
        F.struct(at.alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("n")),
        F.struct((at - width).alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("n")),
        F.struct(at.alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("n")))
    d = requests.select("request_id", "ts", "tenant_id", F.explode(marks).alias("m")).select(
        "request_id", "ts", "tenant_id", "m.*")
    d = running(d, ["tenant_id"], ["at", "kind"], F.floor(F.col("at") / min(width, MINUTE)), sums={"seen": F.col("n")})
    return d.where(F.col("kind") != 1).groupBy("request_id", "ts", "tenant_id").agg(
        F.sum(F.when(F.col("kind") == 2, F.col("seen")).otherwise(-F.col("seen"))).alias("rate"))


def monthly_cap(requests: DataFrame, accounts: DataFrame, plans: DataFrame,
                hint: str = "Upgrade your plan to continue.", slot_seconds: int = 60) -> DataFrame:
    """Refuse requests of a tenant once its month holds as many passed ones as its plan allows.

    ``requests`` has request_id, ts, tenant_id and ``would_pass``.  A request's
    position is needed only in the time slot where the cap is crossed: earlier
    slots pass and later slots are refused as a whole.
    """
    caps = account_plans(accounts, plans).select(
        "tenant_id", F.nullif(F.col("monthly_requests"), F.lit(0)).alias("cap"))
    d = lookup(requests.select("request_id", "ts", "tenant_id", "would_pass"), caps, ["tenant_id"])
    month = F.date_trunc("month", "ts")
    d = d.withColumn("month", month).withColumn("slot", F.floor(F.unix_micros("ts") / (slot_seconds * 1_000_000)))
    passes = F.col("would_pass").cast("long")
    per_slot = d.where(F.col("cap").isNotNull()).groupBy("tenant_id", "month", "slot").agg(F.sum(passes).alias("n"))
    w = Window.partitionBy("tenant_id", "month").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = per_slot.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    d = d.join(per_slot, ["tenant_id", "month", "slot"], "left")
    crossing = F.col("cap").isNotNull() & (F.col("before") < F.col("cap")) & (F.col("before") + F.col("n") >= F.col("cap"))
    inside = Window.partitionBy("tenant_id", "month", "slot").orderBy("ts", "request_id").rowsBetween(
        Window.unboundedPreceding, -1)
    exact = d.where(crossing).withColumn("used", F.col("before") + F.coalesce(F.sum(passes).over(inside), F.lit(0)))
    whole = d.where(~crossing).withColumn("used", F.col("before"))
    out = exact.unionByName(whole)
    over = F.coalesce(F.col("used") >= F.col("cap"), F.lit(False))
    reason = F.concat(F.lit("Monthly request limit reached ("), F.format_number("cap", 0), F.lit(f" requests). {hint}"))
    return out.select("request_id", "ts", "tenant_id", over.alias("capped"), F.when(over, reason).alias("reason"))
