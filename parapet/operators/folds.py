"""Ordered folds with a small carried state, cut into bounded slices.

Some results depend on the previous result of the same key (a limiter that does
not record refused requests, a check that waits for enough new text).  The rows
of a key are cut into slices of bounded size.  All keys' first slices are folded
in parallel; if some key has more slices, its carried state is written out and
joined to the next slice.  A key therefore never sits in one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.storage import written

ROWS_PER_SLICE = 2_000_000


def sliced_fold(rows: DataFrame, keys: list[str], order: list[str], slices: int, fold, out_schema: str) -> DataFrame:
    """Fold rows with columns keys + ``slice`` + ``carried`` in order through ``fold``.

    ``fold(batches)`` streams over batches of sorted rows; rows with ``carried`` true
    come first for a key and are the state left by its slice before.  It yields result
    rows plus the new state as rows with ``carried`` true.  ``out_schema`` must hold
    every input column.
    """
    def step(part: DataFrame) -> DataFrame:
        return (part.repartition(*keys).sortWithinPartitions(*keys, F.desc("carried"), *order)
                .mapInPandas(fold, out_schema))

    if slices <= 1:
        return step(rows).where(~F.col("carried"))
    rows = written(rows)
    results, carry = None, None
    for i in range(slices):
        part = rows.where(F.col("slice") == i)
        if carry is not None:
            # state only matters to keys that go on
            live = carry.join(part.select(*keys).distinct(), keys, "left_semi")
            part = part.unionByName(live.select(*part.columns))
        done = written(step(part))
        carry = done.where("carried").withColumn("slice", F.lit(i + 1).cast("int"))
        hits = done.where(~F.col("carried"))
        results = hits if results is None else results.unionByName(hits)
    return results
