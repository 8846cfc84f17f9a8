"""Katz backoff language model: bigrams that back off to unigrams.

Counts are discounted by Good-Turing up to ``TRUSTED``.  What the discounts free in a
context is shared out over the words not seen there, in proportion to their unigram
probabilities: the backoff weight is that mass over one minus the unigram mass of the seen words, so every
context sums up to one over the vocabulary and one unknown word.

Documents become blocks of word numbers.  A block sends its distinct words, and later its
distinct bigrams, to the shard that owns them; a shard adds up what all blocks have sent,
keeps its part of the model as a row of a partitioned table, and answers each block in the
order in which it asked.  A frequent context is spread over several shards by the next word, and
blocks add up its parts.  Scores are evaluated per distinct bigram of a block: its own
discounted count if it was seen, else the context's weight times the unigram.

Defined results: a null text is empty and has the end token alone; a text's first word has
the end of a text as context; without training texts every token is the unknown word with
probability one; rows that repeat an id are scored each on its own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.blocks import from_planes, pack, planes, unpack
from parapet.llm.texts import LOWER, table
from parapet.storage import remove, written

#: counts above this one are not discounted
TRUSTED = 5
BLOCK_TOKENS, SHARD_TOKENS = 2_000_000, 2_000_000
STRETCH = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
END = b""


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        to = at + STRETCH
        found = _SPACE.search(text, to) if to < len(text) else None
        to = found.start() if found else len(text)
        yield text[at:to].translate(LOWER).split()
        at = to


class Discount:
    """Good-Turing factors for small counts, from the numbers of types seen 1, 2, ... times."""

    def __init__(self, types: list[int], total: int = 0):
        n = [0, *types, *[0] * (TRUSTED + 2)]
        spill = (TRUSTED + 1) * n[TRUSTED + 1] / n[1] if n[1] else 1
        self.factor = np.ones(TRUSTED + 1)
        for r in range(1, TRUSTED + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - spill) / (1 - spill) if n[r] and spill < 1 else 0
            # where the counts of counts are too odd for Good-Turing, half a count is set aside
            self.factor[r] = d if 0 < d < 1 else (r - 0.5) / r
        self.total = total
        self.unknown = 1.0
        if total:
            kept = total - sum(n[r] * r * (1 - self.factor[r]) for r in range(1, TRUSTED + 1))
            self.free = any(n[1:TRUSTED + 1])
            self.unknown = (total - kept) / total if self.free else 1 / (total + 1)

    def counts(self, c: np.ndarray) -> np.ndarray:
        return c * np.where(c <= TRUSTED, self.factor[np.minimum(c, TRUSTED)], 1.0)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probability of words by their counts; 0 stands for the unknown word."""
        if not self.total:
            return np.ones(len(c))
        seen = self.counts(c) / self.total if self.free else c / (self.total + 1)
        return np.where(c > 0, seen, self.unknown)


def conditional(count: np.ndarray, lower: np.ndarray, stats: np.ndarray, d: Discount, unknown: float) -> np.ndarray:
    """P(word | context) by the bigram's count, the word's unigram and the context's row of stats.

    stats: total, number of followers with count 1 to ``TRUSTED``, sum of larger counts, unigram mass of followers.
    """
    total, few, mass = stats[:, 0], stats[:, 1:TRUSTED + 1], stats[:, -1]
    kept = stats[:, TRUSTED + 1] + few @ (np.arange(1, TRUSTED + 1) * d.factor[1:])
    # a context without small counts sets one count aside
    plain = few.sum(axis=1) == 0
    base = np.where(plain, total + 1, total)
    weight = np.where(total > 0, (1 - kept / np.maximum(base, 1)) / np.maximum(1 - mass, unknown), 1.0)
    return np.where(count > 0, d.counts(count) / np.maximum(base, 1), weight * lower)


def context_stats(context: np.ndarray, n: int, count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Rows of stats of ``n`` contexts from their followers' counts (those of 0 are unseen)."""
    seen = count > 0
    context, count, lower = context[seen], count[seen], lower[seen]
    cols = [np.bincount(context, count, n)]
    cols += [np.bincount(context[count == r], minlength=n) for r in range(1, TRUSTED + 1)]
    cols += [np.bincount(context, np.where(count > TRUSTED, count, 0), n), np.bincount(context, lower, n)]
    return np.stack(cols, axis=1).astype(np.float64)


def word_blocks(docs: DataFrame, held: F.Column, id_col: str, text_col: str) -> DataFrame:
    """Rows of up to ``BLOCK_TOKENS`` tokens: word numbers of each text, and the hashes and training counts of the words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, helds, parts, sizes, known = [], [], [], [], {END: 0}

        def full() -> pd.DataFrame:
            ids = np.concatenate(parts)
            train = np.repeat(~np.array(helds), sizes)
            hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in known], dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            ids = rank[ids]
            counts = np.bincount(ids[train], minlength=len(order)).astype(np.int64)
            return pd.DataFrame({"names": [list(names)], "held": [np.array(helds, dtype=np.uint8).tobytes()],
                                 "sizes": [np.array(sizes, dtype=np.int64).tobytes()], "ids": [pack([planes(ids)])],
                                 "words": [pack([hashes[order].tobytes(), planes(counts)])], "end": int(rank[0]),
                                 "n": len(ids)})

        total = 0
        for b in batches:
            for name, held, text in zip(b.iloc[:, 0], b.iloc[:, 1], b.iloc[:, 2]):
                own = [np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words))
                       for words in word_lists((text or "").encode())]
                own = np.concatenate([*own, np.zeros(1, dtype=np.int32)])
                names.append(name)
                helds.append(bool(held))
                parts.append(own)
                sizes.append(len(own))
                total += len(own)
                if total >= BLOCK_TOKENS:
                    yield full()
                    names, helds, parts, sizes, known, total = [], [], [], [], {END: 0}, 0
        if parts:
            yield full()

    rows = docs.select(F.col(id_col).cast("string"), held, F.col(text_col)).mapInPandas(
        run, "names array<string>, held binary, sizes binary, ids binary, words binary, end int, n long")
    return written(rows.withColumn("block", F.monotonically_increasing_id()), "word-blocks", codec="uncompressed")


def bounds_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of hashes begins in a sorted array."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


class Bigrams:
    """Distinct bigrams of a block and what it asks each shard for."""

    def __init__(self, row, counts: np.ndarray, numbers: np.ndarray, shards: int, total: int):
        self.ids = from_planes(unpack(row["ids"])[0], np.int32)
        self.sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        held = np.frombuffer(row["held"], dtype=np.uint8).astype(bool)
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = row["end"]
        key, self.token = np.unique(before.astype(np.int64) * len(counts) + self.ids, return_inverse=True)
        del before
        self.context, self.word = key // len(counts), key % len(counts)
        self.train = np.bincount(self.token[np.repeat(~held, self.sizes)], minlength=len(key)).astype(np.int64)
        # a context with more than a shard's fair part of all tokens has several shards
        spread = np.clip(-(-counts * shards // max(total, 1)), 1, shards)
        home = (numbers * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        shard = (home[self.context] + numbers[self.word].astype(np.int64) % spread[self.context]) % shards
        self.order = np.lexsort((numbers[self.word], numbers[self.context], shard))
        asked = np.unique(self.context)
        times = spread[asked]
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        asked = np.repeat(asked, times)
        ask_shard = (home[asked] + part) % shards
        order = np.lexsort((numbers[asked], ask_shard))
        self.asked, self.ask_shard = asked[order], ask_shard[order]
        self.shard = shard[self.order]
        # items of each question: both are in the order of shard and context
        rank = np.full(len(counts), -1, dtype=np.int64)
        self.n_items = np.zeros(len(self.asked), dtype=np.int64)
        starts = np.append(np.flatnonzero(np.append(True, np.diff(self.ask_shard) != 0)), len(self.asked))
        self.question = np.empty(len(self.order), dtype=np.int64)
        ends = np.searchsorted(self.shard, self.ask_shard[starts[:-1]], side="right")
        begins = np.searchsorted(self.shard, self.ask_shard[starts[:-1]], side="left")
        for q0, q1, i0, i1 in zip(starts[:-1], starts[1:], begins, ends):
            rank[self.asked[q0:q1]] = np.arange(q0, q1)
            self.question[i0:i1] = rank[self.context[self.order[i0:i1]]]
        self.n_items += np.bincount(self.question, minlength=len(self.asked))
        self.slices = [(int(self.ask_shard[q0]), slice(q0, q1), slice(i0, i1))
                       for q0, q1, i0, i1 in zip(starts[:-1], starts[1:], begins, ends)]


def katz_scores(docs: DataFrame, held: F.Column, id_col: str = "doc_id", text_col: str = "text",
                base: float = 0.1) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    blocks = word_blocks(docs, held, id_col, text_col)
    shards = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // SHARD_TOKENS))

    def send_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, cell in zip(b["block"], b["words"]):
                hashes, counts = unpack(cell)
                hashes, counts = np.frombuffer(hashes, dtype=np.uint64), from_planes(counts, np.int64)
                at = bounds_of(hashes, shards)
                for s in range(shards):
                    own = slice(at[s], at[s + 1])
                    if at[s] < at[s + 1]:
                        yield pd.DataFrame({"shard": [s], "block": [block],
                                            "data": [pack([hashes[own].tobytes(), planes(counts[own])])]})

    def add_words(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        """Total counts and numbers of a shard's words, the frequent ones with small numbers."""
        s = int(key[0])
        parts = [unpack(x) for x in d["data"]]
        hashes = [np.frombuffer(p[0], dtype=np.uint64) for p in parts]
        counts = np.concatenate([from_planes(p[1], np.int64) for p in parts])
        words, where = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(where, counts, len(words)).astype(np.int64)
        number = np.empty(len(words), dtype=np.uint64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(words), dtype=np.uint64) * np.uint64(shards) + np.uint64(s)
        out, at = [("model", -1, s, pack([words.tobytes(), planes(total), planes(number)]),
                    [int(total.sum()), int((total > 0).sum()), *np.bincount(total[total <= TRUSTED + 1], minlength=TRUSTED + 2)[1:].tolist()])], 0
        for block, h in zip(d["block"], hashes):
            own = where[at:at + len(h)]
            at += len(h)
            out.append(("answer", block, s, pack([planes(total[own]), planes(number[own])]), None))
        return pd.DataFrame(out, columns=["kind", "block", "shard", "data", "stats"])

    answer = "kind string, block long, shard long, data binary, stats array<long>"
    unigrams = written(blocks.select("block", "words").mapInPandas(send_words, "shard long, block long, data binary")
                       .groupBy("shard").applyInPandas(add_words, answer), "unigrams", codec="uncompressed")

    def summed(model: DataFrame) -> list[int]:
        rows = model.where("kind = 'model'").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        return [r["n"] for r in sorted(rows)]

    total, types, *few = summed(unigrams) or [0, 0]
    one = Discount(few, total)

    def of_words(r: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        parts = [unpack(x) for _, x in sorted(zip(r["shard"], r["data"]))]
        return (np.concatenate([from_planes(p[0], np.int64) for p in parts]),
                np.concatenate([from_planes(p[1], np.uint64) for p in parts]))

    def send_bigrams(key: tuple, d: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        counts, numbers = of_words(r)
        b = Bigrams(d.iloc[0], counts, numbers, shards, total)
        out = []
        for s, q, i in b.slices:
            own = b.order[i]
            out.append((s, int(key[0]), pack([planes(numbers[b.asked[q]]), planes(b.n_items[q]), planes(numbers[b.word[own]]),
                                             planes(counts[b.word[own]]), planes(b.train[own])])))
        return pd.DataFrame(out, columns=["shard", "block", "data"])

    def add_bigrams(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        parts = [[from_planes(x, k) for x, k in zip(unpack(c), (np.uint64, np.int64, np.uint64, np.int64, np.int64))] for c in d["data"]]
        asked, items, word, count, train = (np.concatenate(c) for c in zip(*parts))
        n_asked, n_items = [len(p[0]) for p in parts], [len(p[2]) for p in parts]
        del parts
        contexts, ask = np.unique(asked, return_inverse=True)
        of_item = np.repeat(ask, items)
        order = np.lexsort((word, of_item))
        new = np.append(True, (np.diff(of_item[order]) != 0) | (np.diff(word[order]) != 0)) if len(order) else np.zeros(0, bool)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        sums = np.bincount(number, train).astype(np.int64)
        first = order[new]
        stats = context_stats(of_item[first], len(contexts), sums, one.unigram(count[first]))
        seen = sums > 0
        few = np.bincount(sums[seen & (sums <= TRUSTED + 1)], minlength=TRUSTED + 2)[1:].tolist()
        s = int(key[0])
        # the shard's part of the model, in order of context and word
        out = [("model", -1, s, pack([planes(contexts), planes(stats[:, 0].astype(np.int64)),
                                      planes(np.bincount(of_item[first][seen], minlength=len(contexts))),
                                      planes(word[first][seen]), planes(sums[seen])]), few)]
        mine = np.bincount(np.repeat(np.arange(len(asked)), items), train, len(asked))
        alone = mine == stats[ask, 0]
        q, i = 0, 0
        for block, nq, ni in zip(d["block"], n_asked, n_items):
            own = slice(q, q + nq)
            full = stats[ask[own][~alone[own]]]
            out.append(("answer", block, s, pack([
                planes(sums[number[i:i + ni]]), alone[own].astype(np.uint8).tobytes(),
                *(planes(full[:, c].astype(np.int64)) for c in range(full.shape[1] - 1)), planes(np.ascontiguousarray(full[:, -1]))]), None))
            q, i = q + nq, i + ni
        return pd.DataFrame(out, columns=["kind", "block", "shard", "data", "stats"])

    answers = unigrams.where("kind = 'answer'").select("block", "shard", "data")
    texts = blocks.drop("words")
    sent = texts.drop("names").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(send_bigrams, "shard long, block long, data binary")
    bigrams = written(sent.groupBy("shard").applyInPandas(add_bigrams, answer), "bigrams", codec="uncompressed")
    two = Discount(summed(bigrams))

    def evaluate(key: tuple, d: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        counts, numbers = of_words(r[r["of"] == 1])
        row = d.iloc[0]
        b = Bigrams(row, counts, numbers, shards, total)
        lower = one.unigram(counts)
        count = np.zeros(len(b.order), dtype=np.int64)
        stats = np.zeros((len(b.asked), TRUSTED + 3))
        cells = {s: x for o, s, x in zip(r["of"], r["shard"], r["data"]) if o == 2}
        for s, q, i in b.slices:
            sums, alone, *cols, mass = unpack(cells[s])
            count[i] = from_planes(sums, np.int64)
            alone = np.frombuffer(alone, dtype=np.uint8).astype(bool)
            part = context_stats(b.question[i] - q.start, q.stop - q.start, count[i], lower[b.word[b.order[i]]])
            part[~alone] = np.stack([*(from_planes(c, np.int64) for c in cols), from_planes(mass, np.float64)], axis=1)
            stats[q] = part
        # parts of a spread context add up
        whole = np.stack([np.bincount(b.asked, stats[:, c], len(counts)) for c in range(stats.shape[1])], axis=1)
        p = conditional(count, lower[b.word[b.order]], whole[b.context[b.order]], two, one.unknown)
        log = np.empty(len(p))
        log[b.order] = np.log10(p)
        starts = np.cumsum(b.sizes) - b.sizes
        plain = np.log10((counts + base) / (total + base * (types + 1)))
        return pd.DataFrame({
            "id": row["names"], "held_out": np.frombuffer(row["held"], dtype=np.uint8).astype(bool), "n_tokens": b.sizes,
            "n_known": np.add.reduceat((counts[b.ids] > 0).astype(np.int64), starts), "train_tokens": total,
            "base_score": np.add.reduceat(plain[b.ids], starts), "score": np.add.reduceat(log[b.token], starts)})

    both = answers.withColumn("of", F.lit(1)).unionByName(
        bigrams.where("kind = 'answer'").select("block", "shard", "data", F.lit(2).alias("of")))
    done = texts.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(
        evaluate, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = written(done.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", "n_known",
                              "train_tokens", "base_score", "score"), "scores")
    remove(spark, blocks)
    return out


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0).alias("held")
    return katz_scores(table(spark, sf_dir, "documents"), held)
