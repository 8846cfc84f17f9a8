"""Repetition coverage against a plain model, and its awkward cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from parapet.llm import repetition as rep
from llm.data import docs, prose

W = re.compile(r"[^\x20\x09-\x0D]+")


def model(text):
    words = W.findall(text or "")
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or "")}
    for n in (*rep.GRAM_LIMITS, 8):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        times = Counter(grams)
        inside = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + n)}
        if n == 8:
            out["n_repeat_words"] = len(inside)
        if n in rep.GRAM_LIMITS:
            out[f"dup_chars_{n}"] = sum(len(words[j]) for j in inside)
    lines, seen, out["n_dup_lines"], out["dup_line_chars"] = (text or "").split("\n"), set(), 0, 0
    for line in lines:
        if W.search(line) and line in seen:
            out["n_dup_lines"] += 1
            out["dup_line_chars"] += sum(map(len, W.findall(line)))
        seen.add(line)
    out["base_failed"] = len(words) < 20 or 100 * out["n_repeat_words"] > 30 * len(words)
    out["kept"] = not out["base_failed"] and 100 * out["dup_line_chars"] <= 20 * out["word_chars"] and all(
        100 * out[f"dup_chars_{n}"] <= limit * out["word_chars"] for n, limit in rep.GRAM_LIMITS.items())
    return out


def samples():
    rng = random.Random(5)
    tiny = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) for _ in range(40)]
    lines = ["\n".join(rng.choice(["é a", "é a ", "", " ", "#x | y"]) for _ in range(12)) for _ in range(20)]
    far = prose(rng, 30)
    return [*tiny, *lines, "", None, "   ", "a " * 30, far + " " + prose(rng, 200) + " " + far, "\x1c\x85 x y " * 9,
            "\r\n".join(["one two three four five six"] * 4), " ".join(f"w{i}" for i in range(60)), far + "\n" + prose(rng, 600) + "\n" + far]


def check(texts):
    found = rep.measures([(t or "").encode() for t in texts])
    failed, kept = rep.judged(found)
    for t, row, f, k in zip(texts, found.tolist(), failed, kept):
        want = model(t)
        assert dict(zip(rep.MEASURES, row)) | {"base_failed": bool(f), "kept": bool(k)} == want, t


def test_measures_equal_the_model():
    check(samples())


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(rep, "mixed", lambda ids: np.zeros(len(ids), dtype=np.uint64))
    check(samples())


def test_long_texts_are_numbered_part_by_part(monkeypatch):
    monkeypatch.setattr(rep, "SLICE", 64)
    check(samples())
    assert len(list(rep.cuts(b"ab\n" * 50, rep.SLICE))) > 1


def test_no_texts():
    assert rep.measures([]).shape == (0, len(rep.MEASURES))


def test_awkward_rows_and_clashing_columns(spark):
    frame = docs(spark).withColumnRenamed("_key", "n_words").withColumnRenamed("_id", "dup_chars_5")
    got = [r.asDict() for r in rep.with_repetition(frame).collect()]
    want = [r.asDict() | model(r["text"]) for r in frame.collect()]
    assert sorted(repr(sorted(r.items())) for r in got) == sorted(repr(sorted(r.items())) for r in want)


def test_kept_rows_stay_whole(spark):
    frame = docs(spark).withColumnRenamed("_key", "kept").withColumnRenamed("_id", "base_failed")
    stay = rep.keep_unrepetitive(frame)
    assert stay.columns == frame.columns
    want = [r for r in frame.collect() if model(r["text"])["kept"]]
    assert sorted(map(repr, stay.collect())) == sorted(map(repr, want))


@pytest.mark.parametrize("schema", ["doc_id long, text string", "doc_id string, text string, kept string"])
def test_empty_table(spark, schema):
    assert rep.with_repetition(spark.createDataFrame([], schema)).collect() == []
