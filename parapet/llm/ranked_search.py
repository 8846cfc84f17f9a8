"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks.  A block's signature is a matrix of bits, one row per slot
and one column per document: each term of a document, together with each count level that it reaches
(1, 2, 3, 4, 6, 8 and so on), sets a few rows in the document's column.  Anding the rows of a
term and level gives a bitmap of the documents that may hold it so often: never one too few.  Summed up
with the weights of the terms and what each level can add at most, the bitmaps give every document
of the block an upper bound of its score, for every item and without its text.

A search runs in blocks of items.  The documents with the highest bounds are scored
exactly first; the lowest of an item's full list of exact scores is what a document has to reach.
Every document whose bound reaches it is then scored exactly from its whole text, and the
exact scores are ranked.  Only documents that provably fall short are left out.

Defined results: null texts and texts without terms are never found, and do not count as
documents; an item without terms, or whose terms occur nowhere, has no rows; rows that repeat an
item's id are one item with the terms of all; repeated documents are ranked each on its own;
ids are integers or strings, null ids come last among equal scores; empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.llm.blocks import pack, unpack
from parapet.llm.texts import cuts, table
from parapet.storage import written

MOST = 50
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes that make up terms, A-Z lower-cased; all others become spaces
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
#: counts at which a term sets further rows
LEVELS = np.array(sorted({1, 3} | {1 << i for i in range(1, 31)} | {3 << i for i in range(1, 30)}), dtype=np.int64)
#: rows of a signature for each key of its fullest document, and rows that a key sets
ROWS_PER_KEY, HASHES = 12, 4
#: documents and bytes of a block; bytes that are sorted by number of keys before blocks are cut
BLOCK_DOCS, BLOCK_BYTES, SORTED_BYTES = 512, 2 << 20, 8 << 20
#: terms and items of one run over the index, and terms looked up at once
RUN_TERMS, RUN_ITEMS, CHUNK = 16_384, 2048, 4096
PIECE = 1 << 20
#: the score's constants: 10^9 tf div (1000 tf + 20 m) with m in per cent of the mean length, half of it fixed
TOP, PER_TF, PER_M, FIXED, BY_LENGTH = 1_000_000_000, 1000, 20, 50, 50


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def slots(h: np.ndarray, level: int, rows: int) -> np.ndarray:
    """Rows that each term sets for a level: one line per hash function."""
    a, b = mixed(h, 2 * level + 1), mixed(h, 2 * level + 2) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(rows) for k in range(HASHES)]).astype(np.int64)


def term_counts(data: bytes) -> Counter:
    found = Counter()
    for lo, hi in cuts(data, PIECE, (b" ",)):
        found.update(data[lo:hi].split())
    return found


def signature(hashes: list[np.ndarray], counts: list[np.ndarray], rows: int) -> bytes:
    """Bits of a block, row by row, eight documents a byte."""
    bits = np.zeros((rows, len(hashes)), dtype=bool)
    h, tf = np.concatenate(hashes), np.concatenate(counts)
    doc = np.repeat(np.arange(len(hashes)), list(map(len, hashes)))
    for level, least in enumerate(LEVELS.tolist()):
        reached = tf >= least
        if not reached.any():
            break
        h, tf, doc = h[reached], tf[reached], doc[reached]
        for row in slots(h, level, rows):
            bits[row, doc] = True
    return np.packbits(bits, axis=1).tobytes()


def n_keys(tf: np.ndarray) -> int:
    """Keys of a document: the levels reached by each of its terms."""
    return int(np.searchsorted(LEVELS, tf, side="right").sum())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents of similar size with their signatures and terms (written)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def blocks() -> Iterator[pd.DataFrame]:
            held.sort(key=lambda x: x[0])
            lo = size = 0
            for i, (keys, _, data, _, _) in enumerate(held):
                if i > lo and (i - lo == BLOCK_DOCS or size + len(data) > BLOCK_BYTES or keys > 2 * held[lo][0] + 64):
                    yield block(held[lo:i])
                    lo, size = i, 0
                size += len(data)
            if held:
                yield block(held[lo:])
            held.clear()

        def block(some: list[tuple]) -> pd.DataFrame:
            keys, ids, data, hashes, counts = zip(*some)
            rows = max(64, ROWS_PER_KEY * keys[-1])
            n = [int(c.sum()) for c in counts]
            return pd.DataFrame({
                "ids": [list(ids)], "n": [n], "n_docs": [sum(x > 0 for x in n)], "n_terms": [sum(n)], "rows": [rows],
                "signature": [signature(list(hashes), list(counts), rows)], "data": [pack(list(data))]})

        size = 0
        for batch in batches:
            for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                data = (text or "").encode().translate(TERM_BYTES)
                found = term_counts(data)
                if not found:
                    continue
                h = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
                tf = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                if held and size + len(data) > SORTED_BYTES:
                    yield from blocks()
                    size = 0
                held.append((n_keys(tf), key, data, h, tf))
                size += len(data) + 16 * len(h)
        yield from blocks()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInPandas(
        run, "ids array<string>, n array<long>, n_docs long, n_terms long, rows long, signature binary, data binary")
    return written(rows.withColumn("block", F.monotonically_increasing_id()), "signatures", codec="uncompressed")


@dataclass
class Run:
    """What one run over the index looks for."""

    items: list[Any]
    #: numbers of each item's terms
    of_item: list[np.ndarray]
    words: list[bytes]
    weights: np.ndarray
    n_docs: int
    n_terms: int

    def __post_init__(self):
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), dtype=np.uint64, count=len(self.words))
        # the part of each item's terms in each chunk of terms
        self.parts = [[(i, own[(own >= lo) & (own < lo + CHUNK)] - lo) for i, own in enumerate(self.of_item)]
                      for lo in range(0, len(self.words), CHUNK)]

    def m(self, n: int) -> int:
        return FIXED + BY_LENGTH * n * self.n_docs // self.n_terms

    def bounds(self, rows: int, sig: bytes, n: list[int]) -> np.ndarray:
        """Upper bound of the score of each item (line) in each document of a block."""
        bits = np.frombuffer(sig, dtype=np.uint8).reshape(rows, -1)
        m = np.array([self.m(x) for x in n], dtype=np.float64)
        out = np.zeros((len(self.items), len(n)))
        for c, parts in enumerate(self.parts):
            at = slice(c * CHUNK, (c + 1) * CHUNK)
            gains = self.gains(bits, m, self.hashes[at])
            weights = self.weights[at].astype(np.float64)
            for i, own in parts:
                if len(own):
                    # whole numbers far below 2^53: sums are exact
                    out[i] += weights[own] @ gains[own]
        return out

    def gains(self, bits: np.ndarray, m: np.ndarray, h: np.ndarray) -> np.ndarray:
        """What each term (line) can add to each document at most, before its weight."""
        gains, own, before = np.zeros((len(h), len(m))), np.arange(len(h)), np.zeros(len(m))
        maps = None
        for level in range(len(LEVELS)):
            row = slots(h[own], level, len(bits))
            found = bits[row[0]]
            for r in row[1:]:
                found &= bits[r]
            # who reaches a level has reached those below
            maps = found if maps is None else maps & found
            some = maps.any(axis=1)
            if not some.any():
                break
            own, maps = own[some], maps[some]
            if level + 1 < len(LEVELS):
                most = LEVELS[level + 1] - 1
                reach = np.floor(TOP * most / (PER_TF * most + PER_M * m)) + 1
            else:
                reach = np.full(len(m), float(TOP // PER_TF))
            gains[own] += np.unpackbits(maps, axis=1, count=len(m)) * (reach - before)
            before = reach
        return gains

    def score(self, found: Counter, item: int) -> int:
        m, total = self.m(found.total()), 0
        for t in self.of_item[item].tolist():
            tf = found.get(self.words[t])
            if tf:
                total += int(self.weights[t]) * (TOP * tf // (PER_TF * tf + PER_M * m))
        return total


def document_frequencies(index: DataFrame, words: list[bytes]) -> np.ndarray:
    """Number of documents that hold each of the words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, found = {w: i for i, w in enumerate(words)}, Counter()
        for batch in batches:
            for cell in batch["data"]:
                for data in unpack(cell):
                    seen: set[bytes] = set()
                    for lo, hi in cuts(data, PIECE, (b" ",)):
                        seen.update(number.keys() & data[lo:hi].split())
                    found.update(seen)
        yield pd.DataFrame({"t": [number[w] for w in found], "df": list(found.values())}, dtype="int64")

    out = np.zeros(len(words), dtype=np.int64)
    for r in index.select("data").mapInPandas(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        out[r["t"]] = r["df"]
    return out


def highest_bounds(index: DataFrame, q: Run, most: int) -> dict[int, list[tuple[int, int]]]:
    """block -> (place, item) of the documents with the highest bounds, ``most`` for each item."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bound = np.zeros((len(q.items), 0))
        block, place = np.zeros((len(q.items), 0), dtype=np.int64), np.zeros((len(q.items), 0), dtype=np.int64)
        for batch in batches:
            for number, rows, sig, n in zip(batch["block"], batch["rows"], batch["signature"], batch["n"]):
                here = q.bounds(rows, sig, n)
                bound = np.hstack([bound, here])
                block = np.hstack([block, np.full(here.shape, number)])
                place = np.hstack([place, np.broadcast_to(np.arange(len(n)), here.shape)])
                if bound.shape[1] > most:
                    best = np.argpartition(-bound, most - 1, axis=1)[:, :most]
                    bound, block, place = (np.take_along_axis(x, best, axis=1) for x in (bound, block, place))
        item = np.broadcast_to(np.arange(len(q.items))[:, None], bound.shape)[bound > 0]
        yield pd.DataFrame({"item": item, "bound": bound[bound > 0], "block": block[bound > 0], "place": place[bound > 0]})

    rows = index.select("block", "rows", "signature", "n").mapInPandas(run, "item long, bound double, block long, place long")
    at = Window.partitionBy("item").orderBy(F.col("bound").desc(), "block", "place")
    found = defaultdict(list)
    for r in rows.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= most).collect():
        found[r["block"]].append((r["place"], r["item"]))
    return dict(found)


def scores_to_reach(index: DataFrame, q: Run, first: dict[int, list[tuple[int, int]]], most: int) -> np.ndarray:
    """Score that a document needs, by the exact scores of ``first``; 1 where they do not fill an item's list."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for number, cell in zip(batch["block"], batch["data"]):
                texts, known = unpack(cell), {}
                for place, item in first[number]:
                    if place not in known:
                        known[place] = term_counts(texts[place])
                    out.append((item, q.score(known[place], item)))
            yield pd.DataFrame(out, columns=["item", "score"], dtype="int64")

    # at most RUN_ITEMS times ``most`` numbers
    blocks = F.broadcast(index.sparkSession.createDataFrame([(b,) for b in first], "block long"))
    scored = index.select("block", "data").join(blocks, "block").mapInPandas(run, "item long, score long").where("score > 0")
    least = np.ones(len(q.items))
    for r in scored.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= most).collect():
        least[r["item"]] = r["least"]
    return least


def exact_scores(index: DataFrame, q: Run, least: np.ndarray, most: int, id_type: T.DataType, item: T.StructField) -> DataFrame:
    """item, doc_id and score of every document that may reach ``least``; of each task the first ``most`` of an item."""
    whole = isinstance(id_type, T.IntegralType)

    def order(row: tuple) -> tuple:
        key = row[1]
        return -row[0], key is None, (int(key) if whole else key) if key is not None else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for ids, rows, sig, n, cell in zip(batch["ids"], batch["rows"], batch["signature"], batch["n"], batch["data"]):
                items, places = np.nonzero(q.bounds(rows, sig, n) >= least[:, None])
                if not len(items):
                    continue
                texts, of_place = unpack(cell), defaultdict(list)
                for i, p in zip(items.tolist(), places.tolist()):
                    of_place[p].append(i)
                for p, own in of_place.items():
                    found = term_counts(texts[p])
                    for i in own:
                        if (score := q.score(found, i)) >= least[i]:
                            best[i].append((score, ids[p]))
                            if len(best[i]) >= 4 * most:
                                best[i] = sorted(best[i], key=order)[:most]
        rows = [(i, key, score) for i, own in best.items() for score, key in sorted(own, key=order)[:most]]
        yield pd.DataFrame({item.name: pd.Series([q.items[i] for i, _, _ in rows], dtype=object),
                            "doc_id": pd.Series([k for _, k, _ in rows], dtype=object),
                            "score": pd.Series([s for _, _, s in rows], dtype="int64")})

    schema = T.StructType([item, T.StructField("doc_id", T.StringType()), T.StructField("score", T.LongType())])
    return index.select("ids", "rows", "signature", "n", "data").mapInPandas(run, schema).withColumn(
        "doc_id", F.col("doc_id").cast(id_type))


def search(index: DataFrame, items: DataFrame, most: int = MOST, item_col: str = "item_id", text_col: str = "text",
           id_type: T.DataType | None = None) -> DataFrame:
    """item, rank, doc_id and score of the ``most`` best documents for each item, by runs over blocks of items."""
    id_type = id_type or T.LongType()
    field = T.StructField(item_col, items.schema[item_col].dataType)
    empty = index.sparkSession.createDataFrame([], T.StructType(
        [field, T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())]))
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not totals[0]:
        return empty
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    wanted = written(items.select(F.col(item_col).alias("item"), F.explode(F.regexp_extract_all(
        lowered, F.lit(TERMS), F.lit(0))).alias("term")).distinct(), "items")
    size = wanted.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct(F.struct("item")).alias("items")).first()
    runs = max(-(-size["terms"] // RUN_TERMS), -(-size["items"] // RUN_ITEMS))
    best = empty.drop("rank")
    for run in range(runs):
        own: dict[Any, list[str]] = defaultdict(list)
        for r in wanted.where(F.pmod(F.xxhash64("item"), F.lit(runs)) == run).orderBy("item", "term").collect():
            own[r["item"]].append(r["term"])
        if not own:
            continue
        words = sorted({t for terms in own.values() for t in terms})
        number = {w: i for i, w in enumerate(words)}
        coded = [w.encode() for w in words]
        df = document_frequencies(index, coded)
        n_docs, n_terms = int(totals[0]), int(totals[1])
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        q = Run(list(own), [np.array([number[t] for t in terms], dtype=np.int64) for terms in own.values()], coded, weights,
                n_docs, n_terms)
        least = scores_to_reach(index, q, highest_bounds(index, q, most), most)
        best = best.unionByName(exact_scores(index, q, least, most, id_type, field))
    at = Window.partitionBy(item_col).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= most).select(item_col, "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    docs = table(spark, sf_dir, "documents")
    return search(build_index(docs), table(spark, sf_dir, "benchmark"), id_type=docs.schema["doc_id"].dataType)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS MATERIALIZED (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS MATERIALIZED (SELECT r, doc_id, len(ts) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, s.n),
x AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * t.n * s.n) // s.l))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
