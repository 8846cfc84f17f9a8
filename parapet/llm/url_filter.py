"""URL filter with Bloom filter cascades.

A rule is a host and a path; it fits that host and its subdomains where the URL's path
begins with the rule's.  A URL is looked up by its candidate keys: its last labels and
first path characters, in the numbers that occur in rules.  All candidate keys of the
corpus are the universe.  A cascade's first Bloom filter holds the listed keys, the second the
universe's other keys that the first lets through, the third the listed keys that the
second lets through, and so on until none is left: within the universe, membership is
then exact, and URLs are judged by the filters alone, without a join.  Allowed and blocked keys have a
cascade each; the longest listed candidate is the rule (of equal ones, the one with the
longer host).  Where no key is listed, the method's verdict is ``allow``.

Defined results: a null URL, or one without ``://``, has empty host and path and is allowed;
repeated URLs are judged row by row; an empty table gives no rows; other columns are
not read.  Filters beyond ``MOST_BYTES`` are refused, since every task holds them.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.texts import table
from parapet.storage import written

#: levels halve what is left, so this many only happen to keys that no hash tells apart
MOST_LEVELS = 200
MOST_BYTES = 256 << 20

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def shapes(rules: list[tuple[str, str, str]]) -> list[tuple[int, int]]:
    """Numbers of host labels and path characters that occur in rules."""
    return sorted({(host.count(".") + 1, len(path)) for host, path, _ in rules})


def candidates(host: Column, path: Column, forms: list[tuple[int, int]]) -> Column:
    """Keys of a URL, the longest first; of equal length the one with the longer host first."""
    keys = []
    for labels, chars in forms:
        name = F.substring_index(host, ".", -labels)
        fits = (F.length(host) - F.length(F.replace(host, F.lit("."))) >= labels - 1) & (F.length(path) >= chars)
        key = F.concat(name, F.substring(path, 1, chars))
        keys.append(F.when(fits, F.struct((-F.length(key)).alias("len"), (-F.length(name)).alias("host"), key.alias("key"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*keys))), lambda k: k["key"])


def first_hash(key: Column) -> Column:
    return F.xxhash64(key)


def second_hash(key: Column) -> Column:
    """Spark goes on hashing from the value before, so the constant comes first: it gives the key another seed."""
    return F.xxhash64(F.lit(1), key)


def hashes(key: Column) -> list[Column]:
    return [first_hash(key).alias("h1"), second_hash(key).alias("h2")]


@dataclass
class Level:
    """One Bloom filter: its bits, their number and the number of probes."""

    bits: np.ndarray
    size: int
    probes: int
    salt: int = 0

    def place(self, h1: np.ndarray, h2: np.ndarray, probe: int) -> np.ndarray:
        # each level mixes anew, else keys that collide once would collide in every small filter
        a = h1.view(np.uint64) ^ np.uint64(self.salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        a, b = a ^ (a >> np.uint64(32)), h2.view(np.uint64) | np.uint64(1)
        return (a + np.uint64(probe) * b) % np.uint64(self.size)

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), dtype=bool)
        for i in range(self.probes):
            at = self.place(h1, h2, i)
            out &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


class Cascade:
    """Levels in turn; a key that passes an odd number of them and fails the next is listed."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(h1), dtype=bool), np.arange(len(h1))
        for i, level in enumerate(self.levels):
            at = at[level.passes(h1[at], h2[at])]
            out[at] = i % 2 == 0
        return out


def bloom(keys: DataFrame, n: int, rate: float, salt: int = 0) -> Level:
    """A filter over the keys' h1 and h2; bits are set and merged by Spark."""
    probes = max(1, round(math.log2(1 / rate)))
    size = max(64, math.ceil(n * probes / math.log(2)))
    if size > MOST_BYTES * 8:
        raise ValueError(f"a filter of {size} bits is more than a task may hold; list fewer keys")
    level = Level(np.zeros(size // 64 + 1, dtype=np.uint64), size, probes, salt)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.concatenate([level.place(b["h1"].to_numpy(np.int64), b["h2"].to_numpy(np.int64), i) for i in range(probes)])
            word, where = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
            yield pd.DataFrame({"word": word.view(np.int64), "bits": bits.view(np.int64)})

    words = keys.select("h1", "h2").mapInPandas(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = words.toPandas()
    level.bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return level


def passing(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[level.passes(b["h1"].to_numpy(np.int64), b["h2"].to_numpy(np.int64))]

    return keys.mapInPandas(run, "key string, h1 long, h2 long")


def cascade(universe: DataFrame, listed: DataFrame, n_universe: int) -> Cascade:
    """Both frames hold distinct ``key`` with h1 and h2; every listed key may also be in the universe."""
    n = listed.count()
    if not n:
        return Cascade([])
    rate = min(0.5, max(1e-6, math.sqrt(0.5) * n / max(n_universe, 1)))
    levels = [bloom(listed, n, rate)]
    inside = written(listed, "listed")
    outside = written(passing(universe, levels[0]).join(listed, "key", "left_anti"), "let-through")
    while True:
        for own, other in ((outside, "inside"), (inside, "outside")):
            n = own.count()
            if not n:
                return Cascade(levels)
            if len(levels) == MOST_LEVELS:
                raise ValueError(f"{n} keys pass {MOST_LEVELS} levels alike: they share both 64-bit hashes")
            levels.append(bloom(own, n, 0.5, len(levels)))
            if other == "inside":
                inside = written(passing(inside, levels[-1]), "listed")
            else:
                outside = written(passing(outside, levels[-1]), "let-through")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule and verdict of each row."""
    spark = pages.sparkSession
    forms = shapes(rules)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(id_col, host.alias("host"), path.alias("path"))
    keys = candidates(F.col("host"), F.col("path"), forms)
    universe = written(rows.select(F.explode(keys).alias("key")).distinct().select("key", *hashes(F.col("key"))), "universe")
    n = universe.count()
    sides = {}
    for verdict in ("allow", "block"):
        own = sorted({h + p for h, p, v in rules if v == verdict})
        listed = spark.createDataFrame([(k,) for k in own], "key string").select("key", *hashes(F.col("key")))
        sides[verdict] = cascade(universe, listed, n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["keys"].map(len).to_numpy()
            flat = [k for own in b["keys"] for k in own]
            h1, h2 = (np.concatenate([np.asarray(x, dtype=np.int64) for x in b[c]] or [[]]).astype(np.int64) for c in ("h1", "h2"))
            allow, block = sides["allow"].holds(h1, h2), sides["block"].holds(h1, h2)
            rule, verdict = [None] * len(b), ["allow"] * len(b)
            row = np.repeat(np.arange(len(b)), sizes)
            # from the shortest up, so that the longest listed key stays
            for k in np.flatnonzero(allow | block)[::-1]:
                rule[row[k]], verdict[row[k]] = flat[k], "block" if block[k] else "allow"
            yield b[[id_col, "host", "path"]].assign(rule=rule, verdict=verdict)

    looked = rows.withColumn("keys", keys).withColumn("h1", F.transform("keys", first_hash)).withColumn(
        "h2", F.transform("keys", second_hash))
    kind = pages.schema[id_col].dataType.simpleString()
    return looked.mapInPandas(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"), RULES)


OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l(h, s, v) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + r"""),
f AS (SELECT p.*, l.h || l.s AS rule, l.v,
             row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(l.h || l.s) DESC NULLS LAST, length(l.h) DESC) AS k
      FROM p LEFT JOIN l ON (host = l.h OR ends_with(host, '.' || l.h)) AND starts_with(path, l.s))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1
"""
