"""The divergence audit against plain Python, and its awkward cases."""

import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from parapet.llm import skyband as sky
from llm.data import docs, prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def model(rows, least):
    """(lang, source, part, item, value, rank) for rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        of, total, within = {}, Counter(), Counter()
        for text, source in ((r[0], r[2]) for r in rows if r[1] == lang):
            terms = TERM.findall(lowered(text))
            of.setdefault(source, Counter()).update(terms)
            total.update(terms)
            within.update(set(terms))
        kept = [t for t in total if within[t] >= least]

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in of.items()}, shares(total)
        for s in of:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in of if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, 10)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def plain(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_skyband_keeps_exactly_what_fewer_than_k_dominate(monkeypatch):
    monkeypatch.setattr(sky, "COMPARED", 7)
    rng = random.Random(2)
    for k in (1, 3, 10):
        n = np.array([rng.randrange(6) for _ in range(120)])
        m = np.array([rng.randrange(6) for _ in range(120)])
        term = np.array([f"t{i:03d}é" for i in rng.sample(range(999), 120)], dtype=object)
        want = {i for i in range(120) if sum(j != i and n[j] >= n[i] and m[j] <= m[i] and term[j] < term[i] for j in range(120)) < k}
        assert set(sky.skyband(n, m, term, k).tolist()) == want


@pytest.mark.parametrize("small", [False, True])
def test_equals_the_model(spark, monkeypatch, small):
    if small:
        # buckets, blocks, waiting rows and skybands all in several parts
        for name, value in {"HELD": 40, "PIECE": 16, "WAITING": 5, "COMPARED": 4, "BUCKET": 3, "BLOCK": 2, "MERGED": 2}.items():
            monkeypatch.setattr(sky, name, value)
    rng = random.Random(4)
    rows = [(prose(rng, rng.randrange(0, 60), rng.choice(["abc", "AbÉz", "xyzé"])).title() + rng.choice([" ", "-1_x", "\x7f"]),
             rng.choice(["en", "de", "", None, "rare"]) if i else "alone", rng.choice(["a", "b", "é", "", None, "Z"])) for i in range(300)]
    rows += [rows[7]] * 15 + [("", "bare", "one"), (None, "bare", "two"), ("…", "bare", None)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert plain(sky.divergence(frame, 4)) == model(rows, 4)


def test_awkward_table_with_extra_columns(spark):
    frame = docs(spark)
    for old, new in (("_key", "term"), ("_id", "n"), ("_s", "item")):
        frame = frame.withColumnRenamed(old, new)
    rows = [(r["text"], r["lang"], r["source"]) for r in frame.collect()]
    assert plain(sky.divergence(frame, 3)) == model(rows, 3)


def test_ranks_follow_each_other_and_ties_come_in_byte_order(spark):
    rows = [("k l m n", "en", "a")] * 3 + [("k l m n o", "en", "b")] * 3 + [("p", "en", "c")]
    got = plain(sky.divergence(spark.createDataFrame(rows, "text string, lang string, source string"), 1))
    assert got == model(rows, 1)
    for part in ("pair", "term"):
        for s in "abc":
            ranks = sorted((r[5], -r[4], r[3].encode()) for r in got if r[1] == s and r[2] == part)
            assert [r[0] for r in ranks] == list(range(1, len(ranks) + 1)) and all(a[1:] < b[1:] for a, b in pairwise(ranks))


def test_empty_table(spark):
    assert sky.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
