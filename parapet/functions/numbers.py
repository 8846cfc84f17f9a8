"""Whole numbers of any length as arrays that sort like the numbers they stand for.

A number is an array of longs: how many limbs it has, then its limbs of 15 digits from
the highest on, without leading zero limbs.  Zero has no limbs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet.functions.patterns import let

WIDTH = 15
BASE = 10 ** WIDTH
KIND = "array<bigint>"


def zero() -> Column:
    return F.array(F.lit(0).cast("bigint"))


def from_digits(digits: Column) -> Column:
    """Number of a string of ASCII digits; null if it holds anything else."""
    plain = F.regexp_replace(digits, "^0+", "")
    count = F.ceil(F.length(plain) / WIDTH).cast("int")

    def limbs(s: Column) -> Column:
        padded = F.lpad(s["d"], s["n"] * WIDTH, F.lit("0"))
        parts = F.regexp_extract_all(padded, F.lit(f"[0-9]{{{WIDTH}}}"), F.lit(0))
        return F.concat(F.array(s["n"].cast("bigint")), F.transform(parts, lambda p: p.cast("bigint")))

    return F.when(F.rlike(digits, F.lit(r"\A[0-9]+\z")), let(F.struct(plain.alias("d"), count.alias("n")), limbs))


def plus(number: Column, k: Column) -> Column:
    """The number with a long of less than a limb added; zero if that would be negative."""
    def add(s: Column) -> Column:
        n, at, low = s["n"], F.size(s["n"]), F.when(F.size(s["n"]) > 1, F.element_at(s["n"], -1)).otherwise(0) + s["k"]
        short = F.when(low > 0, F.array(F.lit(1).cast("bigint"), low)).otherwise(zero())
        near = F.concat(F.slice(n, F.lit(1), at - 1), F.array(low))
        fits = (low >= 0) & (low < BASE)
        return F.when(at <= 2, F.when(low < BASE, short).otherwise(_ripple(n, s["k"]))).when(fits, near).otherwise(
            _ripple(n, s["k"]))

    return let(F.struct(number.alias("n"), k.cast("bigint").alias("k")), add)


def _ripple(number: Column, k: Column) -> Column:
    """Addition limb by limb; only where a carry goes beyond the lowest limb."""
    start = F.struct(k.alias("carry"), F.array().cast(KIND).alias("out"))

    def step(s: Column, limb: Column) -> Column:
        total = limb + s["carry"]
        return F.struct(F.floor(total / F.lit(BASE)).cast("bigint").alias("carry"),
                        F.concat(F.array(F.pmod(total, F.lit(BASE))), s["out"]).alias("out"))

    def finish(s: Column) -> Column:
        full = F.when(s["carry"] > 0, F.concat(F.array(s["carry"]), s["out"])).otherwise(s["out"])
        return let(full, lambda x: let(F.when(x[0] == 0, F.slice(x, F.lit(2), F.size(x))).otherwise(x),
                                       lambda y: F.concat(F.array(F.size(y).cast("bigint")), y)))

    low_first = F.reverse(F.slice(number, F.lit(2), F.size(number)))
    return F.aggregate(F.when(F.size(low_first) > 0, low_first).otherwise(zero()), start, step, finish)


def to_string(number: Column) -> Column:
    limbs = F.slice(number, F.lit(2), F.greatest(F.size(number) - 1, F.lit(0)))
    text = F.transform(limbs, lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), WIDTH, F.lit("0"))))
    return F.when(F.size(limbs) > 0, F.array_join(text, "")).otherwise(F.when(number.isNotNull(), "0"))
