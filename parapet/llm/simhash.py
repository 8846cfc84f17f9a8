"""SimHash near-duplicates with the generalised pigeonhole principle.

A fingerprint's bit is set if it is set in over half of the hashes of the text's word
shingles.  Equal fingerprints are one class.  For the search, bits that go together
over all classes are put into one partition, and each query gets its own threshold
per partition: if the thresholds of m partitions sum up to ``most - m + 1``, two fingerprints
that differ in at most ``most`` bits differ in one partition by no more than its threshold.  A small
dynamic program picks the thresholds with the fewest expected candidates and probes, estimated from
histograms of half partitions.  Queries probe the index of partition values, and the
join verifies the distance of whole fingerprints.

Defined results: null, empty and wordless texts have fingerprint zero; fewer words than
a shingle give one shingle of all of them; null ids never name a component while it
holds another id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.components import roots
from parapet.llm.texts import apart, placed, table, words
from parapet.storage import remove, written

SHINGLE, SEED, MOST = 4, 42, 4
PARTS = 3
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    w = words(text)
    if not w:
        return 0
    line = b" ".join(w)
    sizes = list(map(len, w))
    ends = list(accumulate(sizes, lambda at, size: at + 1 + size))
    starts = [e - s for e, s in zip(ends, sizes)]
    n = max(1, len(w) - shingle + 1)
    last = ends[min(shingle, len(w)) - 1:]
    counts = np.zeros(8 * 256, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.fromiter((digest(line[s:e], seed) for s, e in zip(starts[lo:hi], last[lo:hi])), dtype=np.uint64, count=hi - lo)
        b = h.astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts += np.bincount(b.ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(rows: DataFrame, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """Columns of the frame but the text, and ``fp`` (a long with the 64 bits)."""
    kept = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch[text_col]], dtype=np.uint64)
            yield batch[kept].assign(fp=fp.view(np.int64))

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInPandas(run, f"{schema}, fp long")


def bit_columns(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]


def joint_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often bits i and j are set together."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            b = bit_columns(batch["fp"].to_numpy(np.int64)).astype(np.float32)
            total += b.T @ b
            n += len(b)
        yield pd.DataFrame({"k": np.arange(64 * 64 + 1), "n": np.append(total.ravel(), n).astype(np.int64)})

    found = classes.select("fp").mapInPandas(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(64 * 64 + 1)
    for r in found:
        flat[r["k"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def bit_groups(n: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size, each grown by the bit that goes best with it."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    together = np.abs((joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(together, 0)
    free, groups = set(range(64)), []
    for g in range(parts):
        size = 64 // parts + (g < 64 % parts)
        left = sorted(free)
        i, j = divmod(int(together[np.ix_(left, left)].argmax()), len(left))
        group = [left[i]] if i == j else [left[i], left[j]]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(rest[int(together[np.ix_(rest, group)].sum(axis=1).argmax())])
        group = group[:size]
        free -= set(group)
        groups.append(sorted(group))
    return groups


def values(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


def halves(groups: list[list[int]]) -> list[tuple[list[int], list[int]]]:
    return [(g[:len(g) // 2], g[len(g) // 2:]) for g in groups]


def near_shares(classes: DataFrame, groups: list[list[int]], most: int) -> list[list[np.ndarray]]:
    """For each half partition and value, the share of fingerprints at each distance up to ``most``."""
    sides = halves(groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {}
        for batch in batches:
            bits = bit_columns(batch["fp"].to_numpy(np.int64))
            for i, pair in enumerate(sides):
                for j, half in enumerate(pair):
                    found = np.bincount(values(bits, half), minlength=1 << len(half))
                    counts[i, j] = counts.get((i, j), 0) + found
        for (i, j), c in counts.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"part": i, "half": j, "value": at, "n": c[at]})

    found = classes.select("fp").mapInPandas(run, "part int, half int, value long, n long").groupBy(
        "part", "half", "value").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for i, pair in enumerate(sides):
        out.append([])
        for j, half in enumerate(pair):
            own = found[(found["part"] == i) & (found["half"] == j)]
            hist = np.zeros(1 << len(half))
            hist[own["value"]] = own["n"]
            hist /= max(hist.sum(), 1)
            at = np.arange(len(hist))
            out[-1].append(np.stack([sum((hist[at ^ sum(1 << b for b in c)] for c in combinations(range(len(half)), d)),
                                         np.zeros(len(hist))) for d in range(most + 1)]))
    return out


def thresholds(cost: np.ndarray, total: int) -> np.ndarray:
    """cost[query, part, t + 1] for t from -1 on -> thresholds that sum up to ``total`` at least cost."""
    n, parts, levels = cost.shape
    goal = total + parts
    best = np.full((n, goal + 1), np.inf)
    best[:, 0] = 0
    picks = np.zeros((parts, n, goal + 1), dtype=np.int64)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for s in range(goal + 1):
            for level in range(min(s, levels - 1) + 1):
                c = best[:, s - level] + cost[:, i, level]
                better = c < new[:, s]
                new[better, s] = c[better]
                picks[i, better, s] = level
        best = new
    out, left = np.zeros((n, parts), dtype=np.int64), np.full(n, goal)
    for i in reversed(range(parts)):
        level = picks[i, np.arange(n), left]
        out[:, i] = level - 1
        left -= level
    return out


def links(classes: DataFrame, most: int = MOST, parts: int = PARTS, highest: int = 2) -> DataFrame:
    """Pairs (a, b), a < b as signed longs, of fingerprints that differ in at most ``most`` bits.

    ``classes`` holds each ``fp`` once and is read several times; a pair may come more than once.
    """
    n, joint = joint_counts(classes)
    groups = bit_groups(n, joint, parts)
    shares = near_shares(classes, groups, highest)
    masks = [[np.array([sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(len(g)), d)], dtype=np.int64)
              for t in range(highest + 1)] for g in groups]

    def costs(bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits), parts, highest + 2))
        for i, (low, high) in enumerate(halves(groups)):
            a, b = shares[i][0][:, values(bits, low)], shares[i][1][:, values(bits, high)]
            near = np.zeros(len(bits))
            for t in range(highest + 1):
                near = near + sum(a[d] * b[t - d] for d in range(t + 1))
                out[:, i, t + 1] = near * n + len(masks[i][t])
        return out

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                fp = batch["fp"].to_numpy(np.int64)[lo:lo + 4096]
                bits = bit_columns(fp)
                t = thresholds(costs(bits), most - parts + 1)
                for i, g in enumerate(groups):
                    value = values(bits, g)
                    for level in range(highest + 1):
                        own = t[:, i] == level
                        if own.any():
                            m = masks[i][level]
                            key = (value[own][:, None] ^ m).ravel() | (i << 40)
                            yield pd.DataFrame({"key": key, "a": np.repeat(fp[own], len(m))})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            bits = bit_columns(fp)
            for i, g in enumerate(groups):
                yield pd.DataFrame({"key": values(bits, g) | (i << 40), "b": fp})

    probes = classes.select("fp").mapInPandas(probe, "key long, a long")
    entries = classes.select("fp").mapInPandas(index, "key long, b long")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most) & (F.col("a") < F.col("b"))
    return probes.join(entries, (probes["key"] == entries["key"]) & near).select("a", "b")


def near_groups(at: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """A frame from ``placed`` -> _id, fp, _file, _row and _keep, the row that stands for its component."""
    spark = at.sparkSession
    rows = written(fingerprints(at.select(F.col(id_col).alias("_id"), "_file", "_row", F.col(text_col).alias("_text")),
                                "_text", shingle), "fingerprints")
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_file").alias("file"),
                           F.col("_row").alias("row")))
    classes = written(rows.groupBy("fp").agg(first.alias("_first")), "classes")
    found = roots(links(classes, most), "a", "b")
    member = classes.join(found, classes["fp"] == found["node"], "left").select(
        "fp", "_first", F.coalesce("root", "fp").alias("_root"))
    stands = member.groupBy("_root").agg(F.min("_first").alias("_keep"))
    whole = written(member.join(stands, "_root").select("fp", "_keep"), "class-components")
    remove(spark, classes, found)
    return rows.join(whole, "fp")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """The frame with one row of each component; all its columns stay."""
    own, own_id, own_text = apart(docs, id_col, text_col)
    at = placed(own)
    gone = near_groups(at, own_id, own_text, most, shingle).where(
        (F.col("_file") != F.col("_keep.file")) | (F.col("_row") != F.col("_keep.row"))).select("_file", "_row")
    return at.join(gone, ["_file", "_row"], "left_anti").select(*own.columns).toDF(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_groups(placed(table(spark, sf_dir, "documents"))).select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("_keep.id").alias("component_id"))
