"""Small awkward tables for the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, _id string, _s string"


def prose(rng, words, alphabet="abcde"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 6))) for _ in range(words))


def rows(seed=1, n=60):
    """Nulls in every column, empty and long texts, copies, repeated rows, clashing columns."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 80)) for _ in range(12)]
    out = []
    for i in range(n):
        kind = i % 10
        text = rng.choice(base) if kind < 4 else prose(rng, rng.randrange(0, 120))
        if kind == 5:
            text = "  \t" + text.replace(" ", "\r\n ") + " "
        if kind == 6:
            text = rng.choice(base) + " " + prose(rng, 2)
        if kind == 7:
            text = ""
        out.append((i, text, rng.choice(["en", None]), rng.choice(["a", "b", "é", None]), len(text), "k", "x", "y"))
    out += [(n, None, None, None, None, None, None, None), (n + 1, prose(rng, 20_000), "en", "a", 5, "k", "x", "y"),
            (n + 2, "¥ É ß <|endoftext|> don't! stop.\x1cthis 'S $$$", "fr", "b", 3, "k", "x", "y"), out[3], out[3],
            (None, base[0], "en", "a", 1, "k", "x", "y"), (None, "only here", "en", "c", 1, "k", "x", "y")]
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
