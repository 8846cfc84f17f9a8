import random
import re

from pyspark.sql import functions as F

from parapet import fixed_values as fv
from parapet.functions import pii
from parapet.operators import pii as ops
from tests.helpers import message_frame


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0


def model_spans(text, types=None):
    """Spans by plain rules: mark characters of earlier types as taken."""
    taken, out = set(), []
    for ptype in fv.PII_PATTERNS:
        if types is not None and ptype not in types:
            continue
        mine = []
        for m in re.finditer(fv.PII_PATTERNS[ptype], text):
            if ptype == "credit_card" and not luhn(m.group()):
                continue
            if taken.isdisjoint(range(*m.span())):
                mine.append((*m.span(), ptype, m.group()))
                taken.update(range(*m.span()))
        out += mine
    return sorted(out)


def random_texts(n, seed=7):
    rng = random.Random(seed)
    bits = ["a@b.co", "x.y@example.com", "4111111111111111", "4111111111111112", "123-45-6789", "123456789", "555-867-5309",
            "(555) 867-5309", "+1 555 867 5309", "é", "²", "\U0001F600", " ", "-", ".", "\n", "\x1c", "word", "_", "7", "[PII_EMAIL_3]", "[PII_SSN_1]",
            "١٢٣", "5555555555554444", "@", "user5558675309@example.com"]
    return ["".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_spans_equal_model(spark):
    texts = random_texts(3000)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for types in (None, ["phone", "email"]):
        got = {r.i: [tuple(s) for s in r.x] for r in d.select("i", pii.pii_spans(F.col("t"), types).alias("x")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == model_spans(t, types), t


def test_redaction_cases(spark):
    cases = [("My email is alice@example.com", "My email is [REDACTED_EMAIL]"),
             ("Call me at 555-867-5309", "Call me at [REDACTED_PHONE]"), ("SSN 123-45-6789", "SSN [REDACTED_SSN]"),
             ("Card: 4111111111111111", "Card: [REDACTED_CARD]"), ("Order id 4111111111111112 shipped",) * 2,
             ("(555) 867-5309", "([REDACTED_PHONE]"), ("", ""), ("4111 1111 1111 1111",) * 2]
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.x for r in d.select("i", pii.redact_pii(F.col("t")).alias("x")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want


def model_tokens(texts):
    """Sequential numbering over the texts of one request."""
    counters, known, out = {}, {}, []
    for t in texts:
        found = model_spans(t)
        if found:
            for kind, n in re.findall(fv.TOKEN_PATTERN, t):
                counters[kind.lower()] = max(counters.get(kind.lower(), 0), int(n))
        made, last = [], 0
        for s, e, ptype, value in found:
            if (ptype, value) not in known:
                counters[ptype] = counters.get(ptype, 0) + 1
                known[ptype, value] = f"[PII_{ptype.upper()}_{counters[ptype]}]"
            made += [t[last:s], known[ptype, value]]
            last = e
        out.append("".join(made) + t[last:])
    return out, {token: value for (_, value), token in known.items()}


def test_tokens_equal_model(spark):
    texts = random_texts(1600, 11)
    groups = {r: texts[r * 8:(r + 1) * 8] for r in range(100)}
    groups[100] = texts[800:1600]  # one request with half of all texts, over many blocks
    rows = [(r, "t", i, "user", [t]) for r, ts in groups.items() for i, t in enumerate(ts)]
    done = ops.tokenize_pii(ops.text_rows(message_frame(spark, rows)))
    got = {(r.request_id, r.msg_idx): r.text for r in done.texts.collect()}
    vault = {(r.request_id, r.token): r.value for r in done.vault.collect()}
    for r, ts in groups.items():
        want, known = model_tokens(ts)
        assert [got[r, i] for i in range(len(ts))] == want
        assert {t: v for (q, t), v in vault.items() if q == r} == known


def test_literal_and_system_share_numbers(spark):
    rows = [(1, "t", 0, "user", ["[PII_EMAIL_1] is a literal; mine is alice@example.com"]),
            (1, "t", ops.SYSTEM_INDEX, "__system", ["alice@example.com"]),
            (2, "t", 0, "user", ["mine is a@b.co"]), (2, "t", 1, "user", ["[PII_EMAIL_4]"])]
    texts = ops.text_rows(message_frame(spark, rows))
    got = {(r.request_id, r.msg_idx): r.text for r in ops.tokenize_pii(texts).texts.collect()}
    assert got[1, 0].endswith("mine is [PII_EMAIL_2]") and got[1, ops.SYSTEM_INDEX] == "[PII_EMAIL_2]"
    safe = {(r.request_id, r.msg_idx): r.text for r in ops.tokenize_pii(texts, safe_reserve=True).texts.collect()}
    assert got[2, 0] == "mine is [PII_EMAIL_1]" and safe[2, 0] == "mine is [PII_EMAIL_5]"


def test_restore(spark):
    vault = spark.createDataFrame([(1, "[PII_EMAIL_1]", "email", "alice@example.com")], "request_id long, token string, ptype string, value string")
    texts = spark.createDataFrame([(1, 0, "to [PII_EMAIL_1], not [PII_EMAIL_9]"), (2, 0, "[PII_EMAIL_1]"), (1, 1, "none"), (1, 2, None)],
                                  "request_id long, msg_idx int, text string")
    got = {(r.request_id, r.msg_idx): r.text for r in ops.restore_texts(texts, vault, ["request_id", "msg_idx"]).collect()}
    assert got == {(1, 0): "to alice@example.com, not [PII_EMAIL_9]", (2, 0): "[PII_EMAIL_1]", (1, 1): "none", (1, 2): None}


def test_many_matches_in_one_text(spark):
    """Also beyond one group of matches, and with types that claim the same text."""
    parts = [f"user{i}@example.com 555-867-{i % 10000:04d} 123-45-{i % 10000:04d} x555867{i % 10000:04d}@ex.org" for i in range(150)]
    text = " ".join(parts)
    d = spark.createDataFrame([(text,)], "text string")
    got = d.select(pii.pii_spans(F.col("text")).alias("x"), pii.redact_pii(F.col("text")).alias("t")).first()
    expected = model_spans(text)
    assert [(x["s"], x["e"], x["ptype"], x["value"]) for x in got["x"]] == expected
    out, at = [], 0
    for s, e, ptype, _ in expected:
        out += [text[at:s], fv.PII_PLACEHOLDERS[ptype]]
        at = e
    assert got["t"] == "".join(out) + text[at:]


def test_texts_with_very_many_matches(spark):
    """Long texts are walked in parts and claimed cluster by cluster."""
    rng = random.Random(12)
    short = random_texts(400, 21)
    texts = [rng.choice(["", " "]).join(rng.choice(short) for _ in range(rng.choice([20, 150, 600]))) for _ in range(12)]
    texts.append(" ".join(f"a{i}@x.org 555-867-{1000 + i % 9000}" for i in range(5000)))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in d.select("i", pii.pii_spans(F.col("t")).alias("x"), pii.redact_pii(F.col("t")).alias("y")).collect()}
    for i, t in enumerate(texts):
        want, out, at = model_spans(t), "", 0
        assert [tuple(s) for s in got[i].x] == want
        for s, e, ptype, _ in want:
            out, at = out + t[at:s] + fv.PII_PLACEHOLDERS[ptype], e
        assert got[i].y == out + t[at:] and (i < 12 or len(want) == 10_000)
