"""Removal of long repeated byte strings by sorting suffixes, deep and shallow.

A string of ``length`` bytes has one anchor, the 32-byte gram with the least hash in it, so
equal strings have equal anchors at equal places.  Strings of a document that share an
anchor are one segment.  Segments are dealt by anchor: an anchor that occurs once has no repeats
and leaves; equal segments are repeats as a whole and go on as one.  Where segments with one
anchor differ, their texts are sent along and sorted twice, onwards from the anchor
and backwards from it: multikey quicksort orders them to a shallow depth, then a blind trie
orders each group that still agrees, and gives the lengths of common prefixes too.  A
string is repeated if another segment agrees with it far enough on both sides.

Segments of a block of documents are folded before they are sent, so a passage that a
third of all documents share is one row per block.

Defined results: null texts are empty and texts shorter than ``length`` stay whole; removed
bytes may cut a character, so what is kept is bytes; rows that repeat an id are treated each
on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.blocks import block_table, pack, unpack
from parapet.llm.texts import table
from parapet.storage import written

LENGTH, GRAM = 200, 32
#: bytes of a document that are hashed at once
STRETCH = 1 << 20
#: depth to which multikey quicksort goes
SHALLOW = 32
SHARD_BYTES = 16 << 20
#: segments of one anchor that are compared pair by pair
FEW = 40
REPEATED, DIFFERS, SENDER = 1, 2, 4
_MIX = np.random.default_rng(200).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def grams(x: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on, by doubling."""
    h, width = _MIX[x], 1
    while width < GRAM:
        step = np.uint64(pow(_BASE, width, 1 << 64))
        h = h[:-width] * step + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h


def least_in_window(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each window; of values with equal upper bits the first."""
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    n = -(-len(key) // width) * width
    full = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:len(key)] = key
    grid = full.reshape(-1, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(key) - width + 1
    return (np.minimum(tail[:m], head[width - 1:width - 1 + m]) & np.uint64(0xFFFFFF)).astype(np.int64)


def stretch_segments(x: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """anchor hash, content hash, anchor place, first and last string of the segments of a byte array.

    ``starts`` are the documents' first bytes and the array's end; no string crosses them.
    """
    empty = tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(x) < length:
        return empty
    h = grams(x)
    anchor = least_in_window(h, length - GRAM + 1)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = doc[:len(anchor)] == doc[length - 1:length - 1 + len(anchor)]
    label = np.where(whole, anchor, -1)
    label_doc = doc[:len(anchor)]
    cut = np.flatnonzero((label[1:] != label[:-1]) | (label_doc[1:] != label_doc[:-1])) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(label)]]) - 1
    good = label[first] >= 0
    first, last = first[good], last[good]
    if not len(first):
        return empty
    at = label[first]
    with np.errstate(over="ignore"):
        power = np.full(len(x), np.uint64(_BASE | 1), dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_MIX[x] * power)])
        # the last factor takes out where in the array the segment stands
        content = (total[last + length] - total[first]) * power[len(x) - 1 - first] * inverse_power(len(x) - 1)
        content ^= ((at - first).astype(np.uint64) << np.uint64(40)) + ((last - first).astype(np.uint64) << np.uint64(20))
    return h[at], content, at, first, last


def inverse_power(n: int) -> np.uint64:
    return np.uint64(pow(pow(_BASE | 1, -1, 1 << 64), n, 1 << 64))


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """anchor hash, content hash, text number, anchor place, first and last string of every segment."""
    out, group, size = [], [], 0

    def run() -> None:
        x = np.frombuffer(b"".join(p for _, _, p in group), dtype=np.uint8)
        starts = np.cumsum([0, *(len(p) for _, _, p in group)])
        a, c, at, first, last = stretch_segments(x, starts, length)
        part = np.searchsorted(starts, first, side="right") - 1
        text, shift = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        move = shift[part] - starts[part]
        out.append((a, c, text[part], at + move, first + move, last + move))

    for i, data in enumerate(texts):
        for lo in range(0, max(1, len(data) - length + 1), STRETCH):
            piece = data[lo:lo + STRETCH + length - 1]
            if len(piece) < length:
                continue
            if group and size + len(piece) > STRETCH:
                run()
                group, size = [], 0
            group.append((i, lo, piece))
            size += len(piece)
    if group:
        run()
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, *[np.int64] * 4))
    return tuple(np.concatenate(c) for c in zip(*out))


def folded(seg: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (anchor, content) in order: index of one segment of each, its number for every segment, and counts."""
    order = np.lexsort((seg[1], seg[0]))
    a, c = seg[0][order], seg[1][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number, np.diff(np.append(np.flatnonzero(new), len(order)))


# --- the sort --------------------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def shallow_groups(strings: list[bytes], depth: int) -> list[tuple[list[int], int]]:
    """Multikey quicksort to ``depth``: groups in order, each with the length on which it surely agrees."""
    out, stack = [], [(list(range(len(strings))), 0)]
    while stack:
        own, at = stack.pop()
        while True:
            if len(own) == 1 or at == depth:
                out.append((own, at))
                break
            keys = [strings[i][at:at + 1] for i in own]
            pivot = keys[len(keys) // 2]
            less = [i for i, k in zip(own, keys) if k < pivot]
            more = [i for i, k in zip(own, keys) if k > pivot]
            if more:
                stack.append((more, at))
            same = [i for i, k in zip(own, keys) if k == pivot] if less or more else own
            if not less:
                # strings that end here are equal
                if pivot == b"":
                    out.append((same, at))
                    break
                own, at = same, at + 1
                continue
            stack.append((same, at + 1) if pivot != b"" else (same, depth))
            own = less
    return out


class BlindTrie:
    """Orders strings by where they branch; compares a whole string with one leaf only."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        # a node is [depth, children by next byte, leaves that end or stay together here]
        self.root = None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [len(s), {}, [i]]
            return
        node, path = self.root, []
        while True:
            path.append(node)
            below = node[1].get(s[node[0]:node[0] + 1]) if len(s) > node[0] else None
            if below is None:
                break
            node = below
        leaf = node
        while not leaf[2]:
            leaf = next(iter(leaf[1].values()))
        n = common(s, self.strings[leaf[2][0]])
        parent = None
        for node in path:
            if node[0] >= n:
                break
            parent = node
        else:
            node = None
        if node is None:
            # runs on below the last node of the path
            parent[1][s[parent[0]:parent[0] + 1]] = [len(s), {}, [i]]
            return
        if node[0] == n:
            if len(s) == n:
                node[2].append(i)
            else:
                node[1][s[n:n + 1]] = [len(s), {}, [i]]
            return
        # the string leaves an edge half way
        split = [n, {self.strings[leaf[2][0]][n:n + 1]: node}, []]
        if len(s) == n:
            split[2].append(i)
        else:
            split[1][s[n:n + 1]] = [len(s), {}, [i]]
        if parent is None:
            self.root = split
        else:
            parent[1][s[parent[0]:parent[0] + 1]] = split

    def in_order(self) -> list[tuple[int, int]]:
        """(string, length it has in common with the one before) in sorted order."""
        out, stack, low = [], [(self.root, 0)], 0
        while stack:
            node, shared = stack.pop()
            if node is None:
                low = min(low, shared)
                continue
            for i in node[2]:
                out.append((i, low if out else 0))
                low = node[0]
            for k in sorted(node[1], reverse=True):
                stack.append((node[1][k], node[0]))
                stack.append((None, node[0]))
        return out


def sorted_with_lcp(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings and common length with the string before, to ``SHALLOW`` and then deep."""
    order, lcp = [], []
    for own, _ in shallow_groups(strings, SHALLOW):
        if len(own) == 1:
            ranked = [(own[0], 0)]
        else:
            trie = BlindTrie(strings)
            for i in own:
                trie.insert(i)
            ranked = trie.in_order()
        for k, (i, n) in enumerate(ranked):
            order.append(i)
            lcp.append(n if k else (common(strings[order[-2]], strings[i]) if len(order) > 1 else 0))
    return order, lcp


def repeated_strings(lefts: list[bytes], rights: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, given as the bytes before its anchor and from it on: the places, counted
    from the first string, of the strings that another segment holds too.
    """
    out = [np.zeros(0, dtype=np.int64)] * len(rights)
    order, lcp = sorted_with_lcp(rights)
    order, lcp = np.array(order), np.array(lcp)
    cuts = np.flatnonzero(lcp < GRAM)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        if hi - lo < 2:
            continue
        own = order[lo:hi]
        back, back_lcp = sorted_with_lcp([lefts[i][::-1] for i in own])
        left = np.array([len(lefts[i]) for i in own])
        if hi - lo <= FEW:
            hits = pair_hits(lcp[lo:hi].tolist(), back, back_lcp, left.tolist(), length)
        else:
            right = np.array([len(rights[i]) for i in own])
            hits = level_hits(lcp[lo:hi], np.array(back), np.array(back_lcp), left, right, length)
        for k, i in enumerate(own.tolist()):
            out[i] = np.array(sorted(hits[k]), dtype=np.int64)
    return out


def ranges(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, j, common length) of all pairs in a short sorted list."""
    for i in range(len(lcp)):
        low = 1 << 30
        for j in range(i + 1, len(lcp)):
            low = min(low, lcp[j])
            yield i, j, low


def pair_hits(lcp: list[int], back: list[int], back_lcp: list[int], left: list[int], length: int) -> list[set]:
    """Places of repeated strings in a few segments, pair by pair."""
    hits = [set() for _ in lcp]
    before = {}
    for i, j, n in ranges(back_lcp):
        before[back[i], back[j]] = before[back[j], back[i]] = n
    for i, j, n in ranges(lcp):
        for reach in range(max(0, length - n), before[i, j] + 1):
            hits[i].add(left[i] - reach)
            hits[j].add(left[j] - reach)
    return hits


def level_hits(lcp: np.ndarray, back: np.ndarray, back_lcp: np.ndarray, left: np.ndarray, right: np.ndarray,
               length: int) -> list[list]:
    """The same for many segments: for each reach before the anchor, those that agree on both sides."""
    hits = [[] for _ in lcp]
    for reach in range(max(0, length - int(right.max())), int(left.max()) + 1):
        on_right = np.cumsum(np.append(True, lcp[1:] < length - reach))
        on_left = np.empty(len(lcp), dtype=np.int64)
        on_left[back] = np.cumsum(np.append(True, back_lcp[1:] < reach))
        _, where, n = np.unique(on_right * (len(lcp) + 1) + on_left, return_inverse=True, return_counts=True)
        for k in np.flatnonzero((n[where] > 1) & (left >= reach) & (right >= length - reach)).tolist():
            hits[k].append(left[k] - reach)
    return hits


# --- the job ---------------------------------------------------------------

def repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, starts and ends of the removed runs, and the kept bytes of every row."""
    if length < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes at least")
    blocks = block_table(docs, id_col, text_col)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, data in zip(b["block"], b["data"]):
                seg = segments(unpack(data), length)
                one, _, n = folded(seg)
                shard = (seg[0][one] % np.uint64(shards)).astype(np.int64)
                for s in np.unique(shard):
                    own = one[shard == s]
                    yield pd.DataFrame({"shard": [s], "block": [block], "data": [pack([
                        seg[0][own].tobytes(), seg[1][own].tobytes(), np.minimum(n[shard == s], 2).astype(np.uint8).tobytes()])]})

    def meet(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        """Flags of each block's segments, in the order in which they were sent."""
        parts = [unpack(x) for x in d["data"]]
        a = np.frombuffer(b"".join(p[0] for p in parts), dtype=np.uint64)
        c = np.frombuffer(b"".join(p[1] for p in parts), dtype=np.uint64)
        n = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
        _, number, _ = folded((a, c))
        count = np.bincount(number, weights=n)
        order = np.argsort(number, kind="stable")
        first = order[np.flatnonzero(np.append(True, np.diff(number[order]) > 0))]
        _, anchor, kinds = np.unique(a[first], return_inverse=True, return_counts=True)
        differs = kinds[anchor] > 1
        flags = np.where(count > 1, REPEATED, 0) | np.where(differs, DIFFERS, 0)
        flags = flags[number].astype(np.uint8)
        flags[first] |= SENDER
        ends = np.cumsum([len(p[2]) for p in parts])
        return pd.DataFrame({"block": d["block"], "shard": int(key[0]),
                             "flags": [flags[e - len(p[2]):e].tobytes() for e, p in zip(ends, parts)]})

    sent = blocks.mapInPandas(send, "shard long, block long, data binary")
    flags = written(sent.groupBy("shard").applyInPandas(meet, "block long, shard long, flags binary"), "segment-flags")

    def flagged(d: pd.DataFrame, r: pd.DataFrame):
        """Texts, segments, index and number of folded segments, and their flags."""
        texts = unpack(d["data"].iloc[0])
        seg = segments(texts, length)
        one, number, _ = folded(seg)
        shard = (seg[0][one] % np.uint64(shards)).astype(np.int64)
        flag = np.zeros(len(one), dtype=np.uint8)
        for s, x in zip(r["shard"], r["flags"]):
            flag[shard == s] = np.frombuffer(x, dtype=np.uint8)
        return texts, seg, one, number, flag

    def differing(key: tuple, d: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        """Texts of segments that must be sorted, one of each."""
        texts, seg, one, _, flag = flagged(d, r)
        need = np.flatnonzero((flag & (DIFFERS | SENDER)) == (DIFFERS | SENDER))
        shard = (seg[0][one[need]] % np.uint64(shards)).astype(np.int64)
        out = []
        for s in np.unique(shard):
            own = need[shard == s]
            lefts, rights = [], []
            for i in one[own].tolist():
                t, at, lo, hi = texts[seg[2][i]], seg[3][i], seg[4][i], seg[5][i]
                lefts.append(t[lo:at])
                rights.append(t[at:hi + length])
            out.append((s, int(key[0]), pack([own.astype(np.int64).tobytes(), flag[own].tobytes(), pack(lefts), pack(rights)])))
        return pd.DataFrame(out, columns=["shard", "block", "data"])

    def sort(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x) for x in d["data"]]
        lefts = [t for p in parts for t in unpack(p[2])]
        rights = [t for p in parts for t in unpack(p[3])]
        places = repeated_strings(lefts, rights, length)
        out, at = [], 0
        for block, p in zip(d["block"], parts):
            own, flag = np.frombuffer(p[0], dtype=np.int64), np.frombuffer(p[1], dtype=np.uint8)
            found = places[at:at + len(own)]
            at += len(own)
            some = [k for k in range(len(own)) if len(found[k]) and not flag[k] & REPEATED]
            if some:
                out.append((block, pack([own[some].tobytes(), *(found[k].astype(np.int16).tobytes() for k in some)])))
        return pd.DataFrame(out, columns=["block", "data"])

    texts = blocks.select("block", "data").groupBy("block")
    needed = texts.cogroup(flags.groupBy("block")).applyInPandas(differing, "shard long, block long, data binary")
    places = written(needed.groupBy("shard").applyInPandas(sort, "block long, data binary"), "repeated-places")
    answers = flags.select("block", "shard", "flags", F.lit(None).cast("binary").alias("data")).unionByName(
        places.select("block", F.lit(-1).cast("long").alias("shard"), F.lit(None).cast("binary").alias("flags"), "data"))

    def remove(key: tuple, d: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        texts, seg, one, number, flag = flagged(d, r[r["shard"] >= 0])
        whole = np.flatnonzero(flag[number] & REPEATED)
        spans = [(seg[2][whole], seg[4][whole], seg[5][whole] + length)]
        for cell in r.loc[r["shard"] < 0, "data"]:
            own, *found = unpack(cell)
            for k, x in zip(np.frombuffer(own, dtype=np.int64), found):
                i, at = one[k], np.frombuffer(x, dtype=np.int16).astype(np.int64)
                spans.append((np.full(len(at), seg[2][i]), seg[4][i] + at, seg[4][i] + at + length))
        doc, lo, hi = (np.concatenate(c) for c in zip(*spans))
        order = np.lexsort((lo, doc))
        doc, lo, hi = doc[order], lo[order], hi[order]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = []
        for t, (text, name) in enumerate(zip(texts, d["ids"].iloc[0])):
            a, z = lo[bounds[t]:bounds[t + 1]], hi[bounds[t]:bounds[t + 1]]
            if len(a):
                reach = np.maximum.accumulate(z)
                new = np.append(True, a[1:] > reach[:-1])
                a, z = a[new], reach[np.append(new[1:], True)]
            edge = [0, *np.stack([a, z], axis=1).ravel().tolist(), len(text)]
            kept = b"".join(text[edge[k]:edge[k + 1]] for k in range(0, len(edge), 2))
            out.append((name, len(text), a.astype(np.int64), z.astype(np.int64), kept))
        return pd.DataFrame(out, columns=["id", "n_bytes", "starts", "ends", "kept"])

    done = blocks.select("block", "ids", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        remove, "id string, n_bytes long, starts array<long>, ends array<long>, kept binary")
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "starts", "ends", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every document."""
    total = F.aggregate(F.zip_with("starts", "ends", lambda a, z: z - a), F.lit(0).cast("long"), lambda s, n: s + n)
    return repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", total.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
