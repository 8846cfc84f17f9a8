"""Document operators against brute force on small awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm.data import SCHEMA, docs, rows
from parapet.llm import blocks, exact_dedup, katz, mixing, packing, quality, simhash, suffix_dedup
from parapet.llm.components import roots
from parapet.llm.texts import LOWER, placed

SPACE = re.compile("[\x20\x09-\x0d]+")


def norm(text):
    return SPACE.sub(" ", text or "")


def count_words(text):
    return len((text or "").encode().split())


# --- 5: exact dedup

@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))])
def test_exact_groups_also_when_digests_collide(spark, tmp_path, digest):
    path = str(tmp_path / "docs")
    docs(spark).repartition(3).write.parquet(path)
    got = exact_dedup.exact_groups(spark, path, digest=digest).collect()
    groups = collections.defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r[0])
    expected = collections.Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i in ids:
            expected[i, keep, len(ids)] += 1
    assert collections.Counter((r["_id"], r["keep_id"], r["group_size"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_state_goes_on_with_new_files(spark, tmp_path):
    path, at = str(tmp_path / "docs"), str(tmp_path / "state")
    docs(spark, [(5, "a b", None, None, 1, None, None, None)]).write.parquet(path)
    exact_dedup.update_state(spark, path, at).collect()
    docs(spark, [(2, "a  b", None, None, 1, None, None, None), (3, "c", None, None, 1, None, None, None)]).write.mode("append").parquet(path)
    state = {(r["_keep"]["id"], r["_n"]) for r in exact_dedup.update_state(spark, path, at, files_per_batch=1).collect()}
    assert state == {(2, 2), (3, 1)}


def test_drop_copies_keeps_columns(spark):
    kept = exact_dedup.drop_copies(docs(spark))
    assert kept.columns == docs(spark).columns
    assert kept.count() == len({norm(r[1]) for r in rows()})


# --- 4: simhash

def slow_fingerprint(text):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_spark_hash(spark):
    for text in ["", None, "One two", "A b c d", "a b c d e f g a b c d", "É ß x " * 40]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] == np.uint64(
        xxhash.xxh64_intdigest(b"a b c d", 42)).view(np.int64) if hasattr(np.uint64, "view") else True


def test_links_find_every_near_pair(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps):
        for k in range(1, 7):
            g = f
            for b in rng.sample(range(64), k):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(frame).distinct().collect()}
    pairs = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert got == pairs


def test_thresholds_cover(spark):
    rng = np.random.default_rng(1)
    t = simhash.thresholds(rng.random((200, 3, 4)), 2)
    assert (t.sum(axis=1) == 2).all() and t.min() >= -1 and t.max() <= 2


def test_near_groups(spark):
    got = simhash.near_groups(placed(docs(spark))).collect()
    fp = [slow_fingerprint(r[1]) for r in rows()]
    root = list(range(len(fp)))
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {}
    for i, r in enumerate(rows()):
        known = [rows()[j][0] for j in range(len(fp)) if root[j] == root[i] and rows()[j][0] is not None]
        least[i] = min(known) if known else None
    expected = collections.Counter((r[0], fp[i], least[i]) for i, r in enumerate(rows()))
    assert collections.Counter((r["_id"], r["fp"] % (1 << 64), r["_keep"]["id"]) for r in got) == expected
    kept = simhash.drop_near_copies(docs(spark))
    assert kept.columns == docs(spark).columns and kept.count() == len(set(root))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)]
    edges += [(300, 300 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in roots(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    least = {}
    for a, b in edges:
        least.setdefault(a, a)
        least.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {k: v for k, v in least.items() if k != v}


# --- 6: mixing

def targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def test_mixing(spark):
    d = docs(spark)
    keyed = d.select("doc_id", "source", *mixing.keyed(d, 0, "doc_id", "text", "source"))
    got = mixing.taken_words(keyed).collect()
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += count_words(r[1])
    want = targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["_words"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows())
    for s in sizes:
        assert taken[s] == math.floor(want[s] + 0.5)
    again = collections.Counter(map(tuple, mixing.taken_words(keyed.repartition(5)).collect()))
    assert again == collections.Counter(map(tuple, got))
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    have = collections.Counter()
    for r in mixed.collect():
        have[r["source"]] += count_words(r["text"])
    assert have == +taken


# --- 8: packing

def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack_documents(docs(spark), capacity=100).collect()
    bins, texts = collections.defaultdict(list), collections.Counter()
    for r in got:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"] and r["start"] == 100 * r["piece"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        texts[r["doc_id"], r["piece"], tuple(ids)] += 1
    expected, total = collections.Counter(), 0
    for r in rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(0, len(ids), 100):
            expected[r[0], k // 100, tuple(ids[k:k + 100])] += 1
    assert texts == expected
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 100
    assert len(bins) <= -(-total // 100) + 2


def test_local_search_empties_bins():
    lengths = np.array([60, 60, 50, 50, 40, 40], dtype=np.int64)
    bins, fills = [[0, 2], [1, 3], [4], [5]], np.array([110, 110, 40, 40])
    packing.improve(bins, fills, lengths, 150)
    assert sum(bool(b) for b in bins) == 2 and sorted(i for b in bins for i in b) == list(range(6))
    assert [sum(lengths[i] for i in b) for b in bins] == fills.tolist()
    # one for one: 70 + 30 and 60 + 40 instead of 70 + 40, which does not fit
    bins, fills = [[0, 1], [2]], np.array([100, 40])
    packing.improve(bins, fills, np.array([70, 30, 40]), 110)
    assert fills.max() == 110
    # two for one
    bins, fills = [[0, 1], [2, 3]], np.array([80, 60])
    packing.improve(bins, fills, np.array([50, 30, 35, 25]), 90)
    assert fills.max() == 90


# --- 2: quality

def test_quality_learns_and_sees_the_end_of_long_texts(spark):
    rng = random.Random(5)
    good = lambda n: " ".join("".join(rng.choice("aeiourstln") for _ in range(5)) for _ in range(n))
    data = [(i, good(40) if i % 3 else good(20) + " ### $$$ %%%" * 12) for i in range(300)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (7, None), (3, 1), (9999, 0)],
                                   "doc_id long, quality int")
    model = quality.train(d, labels)
    long_bad = good(200_000) + " ### $$$ %%%" * 12
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, long_bad), (1003, good(200_000))], d.schema)
    got = {r["doc_id"]: r["score"] for r in quality.score(d.unionByName(extra), model).collect()}
    assert sum((got[i] >= 0.3) == (i % 3 > 0) for i in range(300)) >= 297
    assert got[1002] < 0.3 <= got[1003] and 0 <= got[1000] == got[1001] <= 1
    # alone or among others, in one segment or several
    one = model.logits([long_bad.encode()])[0]
    assert one == pytest.approx(model.logits([b"x", long_bad.encode(), b"y"])[1], abs=1e-4)
    assert quality.train(d, labels.where("quality = 1")) == 1.0
    assert quality.score(d.limit(0), model).count() == 0
    assert quality.train(d, labels.limit(0)) == 0.5


# --- 3: Katz

def slow_katz(data):
    counts, pairs, texts = collections.Counter(), collections.Counter(), []
    for name, text in data:
        w = [*(text or "").encode().translate(LOWER).split(), b""]
        held = zlib.crc32(b"" if name is None else str(name).encode()) % 10 == 0
        texts.append((name, held, w))
        if not held:
            counts.update(w)
            pairs.update(zip([b"", *w[:-1]], w))
    few = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.TRUSTED + 2)]
    n, v = sum(counts.values()), len(counts)
    one, two = katz.Discount(few(counts), n), katz.Discount(few(pairs))
    unigram = lambda w: float(one.unigram(np.array([counts[w]]))[0])
    after = collections.defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c

    def p(h, w):
        if h not in after:
            return unigram(w)
        f = after[h]
        base = sum(f.values()) + all(c > katz.TRUSTED for c in f.values())
        cut = {x: float(two.counts(np.array([c]))[0]) for x, c in f.items()}
        if w in f:
            return cut[w] / base
        return (1 - sum(cut.values()) / base) / max(1 - sum(map(unigram, f)), one.unknown) * unigram(w)

    return texts, counts, n, v, p, list(after)


@pytest.mark.parametrize(("block", "shard"), [(3000, 5000), (10**9, 10**9)])
def test_katz(spark, monkeypatch, block, shard):
    data = [(r[0], r[1]) for r in rows(3, 80)]
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "SHARD_TOKENS", shard)
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0).alias("held")
    got = collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                               round(r["base_score"], 4), round(r["score"], 4))
                              for r in katz.katz_scores(docs(spark, rows(3, 80)).coalesce(1 if block > 10**6 else 4), held).collect())
    texts, counts, n, v, p, contexts = slow_katz(data)
    expected = collections.Counter()
    for name, held_out, w in texts:
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        own = sum(math.log10(p(h, x)) for h, x in zip([b"", *w[:-1]], w))
        expected[name, held_out, len(w), sum(counts[x] > 0 for x in w), n, round(base, 4), round(own, 4)] += 1
    assert got == expected
    for h in contexts[:10]:
        assert sum(p(h, w) for w in counts) + p(h, b"\0 unknown") == pytest.approx(1)


# --- 10: suffix dedup

def slow_removed(texts, length):
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 4096)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 8192)
    base = "".join(rng.choice("abcdefgh é") for _ in range(400))
    data = [(r[0], r[1] if r[1] is None else r[1][:3000]) for r in rows(8, 40)]
    for i in range(30):
        a = rng.randrange(0, 300)
        part = base[a:a + rng.randrange(40, 200)]
        data.append((500 + i, "".join(rng.choice("xyz") for _ in range(rng.randrange(90))) + part +
                     rng.choice(["", "a" * 130, "ab" * 70, part[::-1]])))
    data += [(700, "q" * 64), (701, "q" * 65), (702, base * 30), (703, base)]
    got = collections.Counter((r["doc_id"], r["n_bytes"], sum(z - a for a, z in zip(r["starts"], r["ends"])), len(r["starts"]),
                               hashlib.sha256(r["kept"]).hexdigest())
                              for r in suffix_dedup.repeated_bytes(spark.createDataFrame(data, "doc_id long, text string"), 64).collect())
    texts = [(t or "").encode() for _, t in data]
    expected = collections.Counter((i, len(t), *x) for (i, _), t, x in zip(data, texts, slow_removed(texts, 64)))
    assert got == expected


def test_deep_shallow_sort():
    rng = random.Random(7)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(70))) for _ in range(300)] + [b"ab" * 40] * 3 + [b""] * 2
    order, lcp = suffix_dedup.sorted_with_lcp(strings)
    assert [strings[i] for i in order] == sorted(strings)
    assert all(lcp[k] == suffix_dedup.common(strings[order[k - 1]], strings[order[k]]) for k in range(1, len(order)))


# --- empty tables

def test_empty_tables(spark, tmp_path):
    none = docs(spark, []).limit(0)
    none.write.parquet(str(tmp_path / "none"))
    held = F.lit(False).alias("held")
    assert exact_dedup.exact_groups(spark, str(tmp_path / "none")).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    assert simhash.near_groups(placed(none)).count() == 0
    assert simhash.drop_near_copies(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert katz.katz_scores(none, held).count() == 0
    assert suffix_dedup.repeated_bytes(none).count() == 0
    assert SCHEMA and blocks.block_table(none).count() == 0


def test_local_search_empties_bins_that_best_fit_leaves():
    """Pieces of a fifth to a third of a bin: best fit leaves many bins with room for none of them."""
    rng = np.random.default_rng(0)
    for lo, hi, most in ((700, 1500, 411), (1000, 2100, 606)):
        lengths = rng.integers(lo, hi + 1, 1500)
        sequence, offset = packing.pack_lengths(lengths, 4096)
        fill = np.bincount(sequence, lengths)
        assert fill.max() <= 4096 and fill.min() > 0 and len(fill) <= most < len(packing.best_fit(lengths, 4096)[0])
        for s in range(len(fill)):
            at = sorted((int(offset[i]), int(lengths[i])) for i in np.flatnonzero(sequence == s))
            assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and at[0][0] == 0


def test_every_step_lets_squared_fills_grow(monkeypatch):
    rng, steps = np.random.default_rng(3), []
    found = packing.best_step

    def watched(donor, sorted_bins, fills, lengths, capacity):
        steps.append(int((fills ** 2).sum()))
        return found(donor, sorted_bins, fills, lengths, capacity)

    monkeypatch.setattr(packing, "best_step", watched)
    for _ in range(20):
        lengths = rng.integers(5, 40, 80)
        bins, fills = packing.best_fit(lengths, 100)
        packing.improve(bins, fills, lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(80))
        assert [int(lengths[b].sum()) if b else 0 for b in bins] == fills.tolist() and fills.max() <= 100
        assert steps == sorted(steps)
        steps.clear()
