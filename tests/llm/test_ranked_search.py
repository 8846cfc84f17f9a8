"""Ranked search against plain Python, its bounds, and its awkward cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from parapet.llm import ranked_search as rs
from llm.data import docs, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def model(rows, items, most=50):
    """(item, rank, doc_id, score) for rows of (doc_id, text) and items of (item_id, text)."""
    counts = [(key, Counter(terms(t))) for key, t in rows]
    counts = [(key, c) for key, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for key, c in counts:
            m = 100 - 50 + 50 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in own if c[t])
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:most])]
    return sorted(out, key=repr)


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def corpus(seed, n=250):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(0, 90), "abÉ9") + rng.choice(["", " X-y_z", "!"])) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(60)] + [(None, rows[3][1]), (5, rows[3][1]), (n + 70, None), (n + 71, " ,;")]
    rows += [(n + 72, prose(rng, 5000, "ab")), (n + 73, "ab " * 3000)]
    items = [(i, " ".join(rng.sample((rows[i * 7][1] + " zz").split(), 1)) + " " + prose(rng, rng.randrange(1, 9), "abÉ9")) for i in range(12)]
    return rows, items + [(90, rows[3][1].upper()), (91, None), (92, "nowhere"), (93, ""), (None, "ab ba"), (90, "extra AB"), (90, "extra AB")]


@pytest.mark.parametrize("small", [False, True])
def test_equals_the_model(spark, monkeypatch, small):
    if small:
        for name, value in {"BLOCK_DOCS": 7, "BLOCK_BYTES": 900, "SORTED_BYTES": 5000, "RUN_TERMS": 20, "RUN_ITEMS": 4, "CHUNK": 5,
                            "PIECE": 64, "ROWS_PER_KEY": 2}.items():
            monkeypatch.setattr(rs, name, value)
    rows, items = corpus(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = rs.search(rs.build_index(frame), spark.createDataFrame(items, "item_id int, text string"))
    assert plain(found) == model(rows, items)


def test_ties_fall_to_the_lower_id_and_lists_are_cut(spark):
    rows, items = corpus(8, 120)
    found = rs.search(rs.build_index(spark.createDataFrame(rows, "doc_id long, text string")),
                      spark.createDataFrame(items, "item_id int, text string"), most=5)
    assert plain(found) == model(rows, items, 5)


def test_string_ids_and_clashing_columns(spark):
    frame = docs(spark).withColumnRenamed("_key", "n").withColumnRenamed("_id", "block").withColumnRenamed("_s", "rows")
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    items = [("x", "abc a e"), ("y", rows[0][1])]
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id string, text string, score int, rank int")
    got = rs.search(rs.build_index(frame), asked)
    assert plain(got) == model(rows, items)
    named = [(None if k is None else f"d{k}", t) for k, t in rows]
    got = rs.search(rs.build_index(spark.createDataFrame(named, "doc_id string, text string")), asked, id_type=T.StringType())
    assert plain(got) == sorted(((i, r, k, s) for i, r, k, s in model(named, items)), key=repr)


def test_bounds_never_fall_short(spark):
    rows, items = corpus(5)
    index = rs.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    words = sorted({t for _, text in items for t in terms(text)})
    own = [np.array([words.index(t) for t in sorted(set(terms(text)))], dtype=np.int64) for _, text in items]
    n_docs, n_terms = index.selectExpr("sum(n_docs)", "sum(n_terms)").first()
    q = rs.Run([i for i, _ in items], own, [w.encode() for w in words], np.arange(1, len(words) + 1), n_docs, n_terms)
    checked = 0
    for b in index.collect():
        bounds = q.bounds(b["rows"], b["signature"], b["n"])
        for p, data in enumerate(rs.unpack(b["data"])):
            for i in range(len(items)):
                exact = q.score(rs.term_counts(data), i)
                assert bounds[i, p] >= exact
                checked += exact > 0
    assert checked > 500


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    full = rs.build_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert rs.search(rs.build_index(none), items).collect() == []
    assert rs.search(rs.build_index(spark.createDataFrame([(1, None)], "doc_id long, text string")), items).collect() == []
    assert rs.search(full, spark.createDataFrame([], "item_id int, text string")).collect() == []
    assert len(rs.search(full, items).collect()) == 1
