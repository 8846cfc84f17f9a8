"""Packing documents into sequences: best fit, then swap-based local search.

Texts become token ids and are cut into pieces of at most ``capacity``.  Pieces are
dealt at random to groups of about ``GROUP`` pieces; each group is packed on its own,
best fit decreasing first, then a local search over its underfull bins: it moves a
piece, exchanges one for one or two for one, always so that the sum of squared fills
grows, until bins run empty or nothing helps any more.  A group leaves a few bins unfilled at most, so the loss against
one packing of everything is about one bin in a thousand.

Defined results: a null text is empty and gives the end token alone; rows that repeat
an id are packed each on its own; an empty table gives no rows; columns whose names
clash with the results are replaced.
"""

from __future__ import annotations

import gc
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.llm.texts import LOWER, table
from parapet.storage import written

CAPACITY = 4096
END = 1
#: pieces in a group: what one task packs at once
GROUP = 8192
#: words of at most so many bytes are remembered by a task, in about so many bytes of memory, each with so many besides its own
WORD_BYTES, KEPT_BYTES, EACH_BYTES = 48, 120 << 20, 250
LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: punctuation that may be cut off a word's end, and ends before which it may
TAIL, STEM_END = b".,!?;:%$&*#|", frozenset(bytes([b]) for b in b"abcdefghijklmnopqrstuvwxyz0123456789")
VOCABULARY = "word_bpe_49k.json"


class Ids:
    """Token ids of texts as little-endian 32-bit bytes.

    A vocabulary that splits at white space and drops it gives a text the ids of its
    words in a row; words come again and again and are looked up.  New words
    are encoded many at once, with a mark between them that is one token of its own.  The last
    words seen are kept in two halves; when the newer is full, it takes the place of the older.
    Whether the vocabulary lower-cases A-Z and parts punctuation from words is tried on it
    first; one that does not has its texts encoded as they are.
    """

    MARK = "\u00a5"

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.mark = self._ids(self.MARK)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.by_word = self._goes_by_word()

    def _goes_by_word(self) -> bool:
        """Whether samples of all that ``learn`` relies on hold for this vocabulary."""
        one = lambda t: self._ids(t).tolist()
        letters = LETTERS.decode()
        stems = ["word", "Zebra", "x", "7", "éa"]
        return (all(one(s + " " + t) == one(s) + one(t) and one(s + "\t\n" + t) == one(s) + one(t) for s in stems for t in stems)
                and all(one(s + chr(c)) == one(s) + one(chr(c)) and one(s + chr(c) * 2) == one(s) + one(chr(c) * 2) for s in stems[:4] for c in TAIL)
                and one(letters.upper()) == one(letters) and one(" word ") == one("word")
                and all(list(np.frombuffer(self._letters(s), dtype="<u4")) == one(s.decode()) for s in (b"word", LETTERS)))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _encode(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        if len(self.mark) == 1 and not any(self.MARK in t for t in texts):
            ids = self._ids(f" {self.MARK} ".join(texts))
            cuts = (np.flatnonzero(ids == self.mark[0]) * 4).tolist()
            if len(cuts) == len(texts) - 1:
                data = ids.tobytes()
                return [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)])]
        return [self._ids(t).tobytes() for t in texts]

    def learn(self, texts: list[list[bytes]]) -> None:
        """Look up the short words of several texts at once.

        A-Z may be lower-cased first, as the vocabulary does itself; and a word that ends
        in a letter or digit and then punctuation has the ids of both in a row.
        """
        if len(self.known) * EACH_BYTES > KEPT_BYTES // 2:
            self.older, self.known = self.known, {}
        # nothing here is circular, and looking for cycles among so many small objects costs more than the work
        collects = gc.isenabled()
        gc.disable()
        try:
            self._learn(texts)
        finally:
            if collects:
                gc.enable()

    def _learn(self, texts: list[list[bytes]]) -> None:
        known, older = self.known, self.older
        new = set().union(*texts).difference(known)
        seen = new.intersection(older)
        known.update((w, older[w]) for w in seen)
        made, wanted = [], set()
        for w in new - seen:
            if len(w) > WORD_BYTES:
                continue
            if w.isalpha():
                known[w] = self._letters(w.lower())
                continue
            core = w if b"<|" in w else w.translate(LOWER)
            stem = core.rstrip(TAIL)
            if stem and len(stem) < len(core) and stem[-1:] in STEM_END:
                made.append((w, stem, core[len(stem):]))
                wanted.add(core[len(stem):])
                if not stem.isalpha():
                    wanted.add(stem)
            else:
                made.append((w, core, b""))
                wanted.add(core)
        rest = [w for w in wanted if w not in known]
        for lo in range(0, len(rest), 20_000):
            known.update(zip(rest[lo:lo + 20_000], self._encode(rest[lo:lo + 20_000])))
        known[b""] = b""
        for w, stem, tail in made:
            known[w] = (known[stem] if stem in known else self._letters(stem)) + known[tail]

    def _letters(self, word: bytes) -> bytes:
        """Ids of a-z alone: one piece that normalising and splitting leave as it is."""
        ids = self.known.get(word) or self.older.get(word)
        if ids is None:
            ids = struct.pack("<%dI" % len(found := self.tokenizer.model.tokenize(word.decode())), *[t.id for t in found])
        self.known[word] = ids
        return ids

    def of(self, words: list[bytes]) -> bytes:
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            own = {w: self._ids(w.decode()).tobytes() for w in set(words) if w not in known}
            return b"".join([known[w] if w in known else own[w] for w in words])

    def of_texts(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_word:
            yield from (self._ids(t).tobytes() for t in texts)
            return
        words = [t.encode().split() for t in texts]
        self.learn(words)
        yield from map(self.of, words)


def tokenized(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        ids = Ids(path)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                keys, texts = batch.iloc[lo:lo + 500, 0], [t or "" for t in batch.iloc[lo:lo + 500, 1]]
                out = []
                for key, data in zip(keys, ids.of_texts(texts)):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at:at + 4 * capacity]
                        out.append((key, k, at // 4, len(part) // 4, part))
                yield pd.DataFrame(out, columns=[f.name for f in schema]).astype({"piece": "int32"})

    return docs.select(id_col, text_col).mapInPandas(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[list[list[int]], np.ndarray]:
    """Best fit decreasing: members of each bin, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, dtype=np.int32)
    bins, fills = [], []
    for i in order.tolist():
        size = int(lengths[i])
        ahead = open_rooms[size:]
        room = int(ahead.argmax()) if ahead.any() else -1
        if room < 0 or not ahead[room]:
            b, room = len(bins), capacity
            bins.append([])
            fills.append(0)
        else:
            room += size
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms[room] = 0
        bins[b].append(i)
        fills[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            open_rooms[left] = 1
    return bins, np.array(fills, dtype=np.int64)


class Partners:
    """Pieces of the bins that still have room, sorted by bin and length, so that what fits is looked up."""

    def __init__(self, targets: list[int], sorted_bins: dict[int, np.ndarray], fills: np.ndarray, lengths: np.ndarray, capacity: int):
        self.targets = np.array(targets, dtype=np.int64)
        self.width = capacity + 1
        self.fill = fills[self.targets]
        self.room = capacity - self.fill
        self.ids = np.concatenate([sorted_bins[t] for t in targets]) if targets else np.zeros(0, dtype=np.int64)
        self.owner = np.repeat(np.arange(len(targets)), [len(sorted_bins[t]) for t in targets])
        self.size = lengths[self.ids]
        self.keys = self.owner * self.width + self.size

    def at_least(self, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Place of the smallest piece of at least such a size in each bin; it may belong to a later bin."""
        return np.searchsorted(self.keys, owner * self.width + np.maximum(size, 1))

    def value(self, gain: np.ndarray, owner: np.ndarray, donor_fill: int) -> np.ndarray:
        """By how much squared fills grow when so much goes over to each bin; 0 where nothing does."""
        return np.where(gain > 0, gain * (self.fill[owner] - donor_fill + gain), 0)

    def for_one(self, give: int, donor_fill: int) -> tuple[int, int, tuple[int, ...]]:
        """Best way to take ``give`` in for nothing or one smaller piece: (value, target, pieces handed back)."""
        every = np.arange(len(self.targets))
        moved = self.value(np.where(self.room >= give, give, 0), every, donor_fill)
        at = self.at_least(every, give - self.room)
        there = np.minimum(at, max(len(self.keys) - 1, 0))
        fits = (at < len(self.keys)) & (self.owner[there] == every) & (self.size[there] < give)
        swapped = self.value(np.where(fits, give - self.size[there], 0), every, donor_fill)
        m, w = int(moved.argmax()), int(swapped.argmax())
        if moved[m] >= swapped[w]:
            return int(moved[m]), m, ()
        return int(swapped[w]), w, (int(self.ids[there[w]]),)

    def for_two(self, give: int, donor_fill: int) -> tuple[int, int, tuple[int, ...]]:
        """Best way to take ``give`` in for two pieces that are smaller together."""
        own = np.arange(len(self.keys))
        at = np.maximum(self.at_least(self.owner, give - self.room[self.owner] - self.size), own + 1)
        there = np.minimum(at, len(self.keys) - 1)
        both = self.size + self.size[there]
        fits = (at < len(self.keys)) & (self.owner[there] == self.owner) & (both < give) & (give - both <= self.room[self.owner])
        value = self.value(np.where(fits, give - both, 0), self.owner, donor_fill)
        w = int(value.argmax())
        return int(value[w]), int(self.owner[w]), (int(self.ids[w]), int(self.ids[there[w]]))


def improve(bins: list[list[int]], fills: np.ndarray, lengths: np.ndarray, capacity: int, least: int = 0) -> None:
    """Local search between bins with room, in place, until a full pass over them gains nothing.

    Each bin in turn, the emptiest first, gives a piece away, exchanges one for a smaller one, one for two
    that are smaller together or two for one, always with the bin where squared fills grow most,
    until it is empty or no step lets them grow.  The search also ends when no more than ``least`` bins are left.
    """
    count = int((fills > 0).sum())
    sorted_bins = {b: np.array(sorted(bins[b], key=lengths.__getitem__), dtype=np.int64) for b in range(len(bins)) if 0 < fills[b] < capacity}
    gained = True
    while gained and count > least:
        gained = False
        for donor in sorted(sorted_bins, key=lambda b: fills[b]):
            while count > least and 0 < fills[donor] < capacity and (plan := best_step(donor, sorted_bins, fills, lengths, capacity)):
                give, target, take = plan
                gain = int(lengths[list(give)].sum() - lengths[list(take)].sum())
                bins[donor] = [i for i in bins[donor] if i not in give] + list(take)
                bins[target] = [j for j in bins[target] if j not in take] + list(give)
                fills[donor] -= gain
                fills[target] += gain
                gained = True
                for b in (donor, target):
                    if 0 < fills[b] < capacity:
                        sorted_bins[b] = np.array(sorted(bins[b], key=lengths.__getitem__), dtype=np.int64)
                    else:
                        sorted_bins.pop(b, None)
                if not fills[donor]:
                    count -= 1


def best_step(donor: int, sorted_bins: dict[int, np.ndarray], fills: np.ndarray, lengths: np.ndarray,
              capacity: int) -> tuple[tuple[int, ...], int, tuple[int, ...]] | None:
    """Pieces the donor gives, to which bin, and what it takes for them; None if no step lets squared fills grow.

    Steps with two pieces on one side are only looked for where no simpler one helps.
    """
    mine = sorted_bins[donor]
    index = Partners([b for b in sorted_bins if b != donor], sorted_bins, fills, lengths, capacity)
    if not len(index.targets):
        return None
    single = {int(lengths[i]): (int(i),) for i in mine}
    pairs: dict[int, tuple[int, ...]] = {}
    for looked, gives in ((index.for_one, single), (index.for_two, single), (index.for_one, pairs)):
        if gives is pairs:
            room = int(index.room.max()) + int(index.size.max())
            for x in range(len(mine)):
                for y in range(x + 1, len(mine)):
                    if (both := int(lengths[mine[x]] + lengths[mine[y]])) > room:
                        break
                    pairs.setdefault(both, (int(mine[x]), int(mine[y])))
        best, plan = 0, None
        for size, ids in gives.items():
            value, target, take = looked(size, int(fills[donor]))
            if value > best:
                best, plan = value, (ids, int(index.targets[target]), take)
        if plan:
            return plan
    return None


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every piece."""
    bins, fills = best_fit(lengths, capacity)
    # fewer bins than their total needs there cannot be
    improve(bins, fills, lengths, capacity, -(-int(lengths.sum()) // capacity))
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    n = 0
    for members in bins:
        if members:
            at = 0
            for i in members:
                sequence[i], offset[i] = n, at
                at += int(lengths[i])
            n += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Written pieces with a column ``length`` -> the same with sequence_id and offset.

    All other columns are carried along; give each piece a ``_deal`` that spreads evenly.
    """
    n = pieces.count()
    groups = max(1, -(-n // group))
    carried = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_deal", "_group")]
    schema = T.StructType([pieces.schema[c] for c in carried] + [
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = pack_lengths(rows["length"].to_numpy(np.int64), capacity)
        rows = rows[carried].copy()
        rows["sequence_id"] = sequence + (int(key[0]) << 32)
        rows["offset"] = offset
        return rows

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_deal"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", payload: dict | None = None) -> DataFrame:
    """Documents -> placed pieces with their token ids, or with ``payload`` columns made from ``ids``."""
    payload = {"ids": F.col("ids")} if payload is None else payload
    cut = tokenized(docs, capacity, vocabulary, id_col, text_col)
    cut = cut.select(id_col, "piece", "start", "length", *[v.alias(k) for k, v in payload.items()],
                     F.monotonically_increasing_id().alias("_deal"))
    # written once: counting and packing then see the same numbers
    return pack(written(cut, "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, payload={"ids_crc32": F.crc32("ids")})
