"""Live streams kept together in buckets.

Handing a group over to Python and storing its state costs far more than a chunk or a line does,
and a stream has few of them.  A bucket's streams are handed over at once; its state has one
entry per live stream, led by stream and the time up to which it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 2048
IDLE_MS = 3_600_000


def bucket(stream: str) -> Column:
    return F.pmod(F.xxhash64(stream), F.lit(BUCKETS))


def streams_of(pdf: pd.DataFrame, key: tuple, order: list[str]) -> Iterator[tuple[str | None, np.ndarray]]:
    """Each stream of a group with the places of its rows in order; rows that name no stream belong to the key's."""
    names = pdf["stream_id"] if "stream_id" in pdf else pd.Series([key[0]] * len(pdf), dtype=object)
    codes, known = pd.factorize(names)
    by = [pd.to_numeric(pdf[c]).fillna(-1).to_numpy(np.int64) for c in reversed(order)]
    places = np.lexsort([*by, codes])
    ordered = codes[places]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(places) else []
    for lo, hi in zip(starts, [*starts[1:], len(places)]):
        code = ordered[lo]
        yield (None if code < 0 else known[code]), places[lo:hi]


def set_alarm(state, known: dict, seen: dict) -> None:
    """Store the entries of streams that were not seen in this micro-batch and are not yet idle, and of those that were.

    The group is asked for again when the first of them has been idle for its time.
    """
    at = state.getCurrentWatermarkMs()
    entries = {s: e for s, e in known.items() if e[0] >= at} | seen
    if not entries:
        state.remove()
        return
    state.update((list(entries), *map(list, zip(*entries.values()))))
    state.setTimeoutTimestamp(max(min(e[0] for e in entries.values()), at + 1))
