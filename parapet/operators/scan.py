"""Ordered running values and lookups that hold up under hot keys.

A window partitioned by a hot key would sort all rows of that key in one task.
``running`` splits every key into blocks that are consecutive in the order:
rows are windowed inside (key, block), block totals are windowed per key, and
the two are joined.  No task sees more than one block of rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.storage import written

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 16


def running(df: DataFrame, keys: list[str], order: list, block: Column,
            sums: dict[str, Column] | None = None,
            maxes: dict[str, Column] | None = None) -> DataFrame:
    """Add running inclusive sums and maxima in the given order per key.

    ``block`` must not decrease along the order.  A running maximum of a struct
    (position, value) carries the last value forward.
    """
    sums, maxes = sums or {}, maxes or {}
    d = df.withColumn("__blk", block)
    here = (Window.partitionBy(*keys, "__blk").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = (Window.partitionBy(*keys).orderBy("__blk")
              .rowsBetween(Window.unboundedPreceding, -1))
    local = d
    for name, value in sums.items():
        local = local.withColumn(name, F.sum(value).over(here))
    for name, value in maxes.items():
        local = local.withColumn(name, F.max(value).over(here))
    totals = d.groupBy(*keys, "__blk").agg(
        *[F.sum(v).alias(f"__t_{n}") for n, v in sums.items()],
        *[F.max(v).alias(f"__t_{n}") for n, v in maxes.items()])
    carry = totals.select(
        *keys, "__blk",
        *[F.sum(f"__t_{n}").over(before).alias(f"__c_{n}") for n in sums],
        *[F.max(f"__t_{n}").over(before).alias(f"__c_{n}") for n in maxes])
    out = local.join(carry, [*keys, "__blk"])
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"__c_{name}"), F.lit(0)))
    for name in maxes:
        out = out.withColumn(name, F.greatest(F.col(name), F.col(f"__c_{name}")))
    return out.drop("__blk", *[f"__c_{n}" for n in (*sums, *maxes)])


def in_order(df: DataFrame, order: list, name: str = "ordered", partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The frame written once as consecutive ranges of the order, and where each range begins.

    ``__at`` holds a row's range in its high bits and its place there in its low 33; the second frame
    has a row (__range, __before) per range, so it is as small as their number.  Together they
    number all rows without any task seeing more than one range.
    """
    ranged = df.repartitionByRange(*order) if partitions is None else df.repartitionByRange(partitions, *order)
    rows = written(ranged.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    sizes = rows.groupBy(F.shiftright("__at", 33).alias("__range")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return rows, sizes.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, order: list, number: str = "n", name: str = "numbered") -> DataFrame:
    """Rows numbered from 1 in the given order over the whole frame."""
    rows, starts = in_order(df, order, name)
    d = rows.join(F.broadcast(starts), F.shiftright("__at", 33) == F.col("__range"))
    return d.withColumn(number, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).select(*df.columns, number)


def preceding_text(df: DataFrame, keys: list[str], rank: str, piece: Column, width: int,
                   out: str, separator: str = "", block_rows: int = 4096) -> DataFrame:
    """Add the last ``width`` characters of the joined text before each row.

    ``rank`` numbers the rows of a key from 1 without gaps.  Each row adds its
    piece; with no separator, pieces must not be empty.  At most ``width``
    rows before a row matter, so that many rows are copied over each block edge.
    """
    halo = width
    step = max(block_rows, halo + 1)
    tail = F.right(piece, F.lit(width))
    slot = F.floor((F.col(rank) - 1) / step)
    near_end = (F.col(rank) - 1) % step >= step - halo
    own = F.struct(slot.alias("slot"), F.lit(False).alias("copy"))
    over = F.struct((slot + 1).alias("slot"), F.lit(True).alias("copy"))
    places = F.when(near_end, F.array(own, over)).otherwise(F.array(own))
    names = df.columns
    d = df.withColumn("__tail", tail).withColumn("__at", F.explode(places))
    w = Window.partitionBy(*keys, "__at.slot").orderBy(rank)
    # rows that are not there are null and leave no separator
    joined = F.concat_ws(separator, *[F.lag("__tail", i).over(w) for i in range(halo, 0, -1)])
    return d.withColumn(out, F.right(joined, F.lit(width))).where(~F.col("__at.copy")).select(*names, out)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of a plan, without running it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.VariantType, T.MapType))


def lookup(facts: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a lookup table that has one row per key to a fact table.

    The table is broadcast only if its estimated size is within a bound.  Beyond it
    both sides are shuffled once, and adaptive execution splits a hot key's rows.
    """
    if estimated_bytes(table) <= BROADCAST_BYTES:
        return facts.join(F.broadcast(table), on, how)
    return facts.join(table, on, how)
