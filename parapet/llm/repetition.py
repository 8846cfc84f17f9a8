"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words of a slice of documents become numbers, equal words equal numbers.  Hashes of windows of
n words roll on from those of n - 1 words, for all starts at once in numpy; windows of the same
document with equal hashes are compared word by word before they count, so no two different
windows are ever taken for one.  A window of n words can only be found twice where both windows of
n - 1 words inside it are, so longer lengths look at what the length before left over.
Words covered by any duplicated window count once per length, weighted by their characters; lines
equal to an earlier line of their document count with the characters of their words.

A document is kept if the base rules hold and no length's share of characters is above its
limit in ``GRAM_LIMITS`` (per cent, by words in the window) or ``LINE_LIMIT``.

Defined results: null and wordless texts count zero everywhere and fail the base rules; fewer
words than a window give no window; rows are judged one by one, so repeated rows and null
ids stay as they are; an empty table gives no rows; other columns are carried along, and
those named like a measure are replaced.  A text is held by one task, with some thirty
bytes of numbers for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parapet.llm.texts import WORDS, cuts, table

#: per cent of word characters that duplicated windows of so many words may cover
GRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: per cent of word characters that lines equal to an earlier one may hold
LINE_LIMIT = 20
REPEAT_WORDS, REPEAT_LIMIT, LEAST_WORDS = 8, 30, 20
SYMBOLS = b"#*$%&|<>"
#: bytes of text worked on at once; a longer text is worked on by itself
SLICE = 1 << 20
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
GRAMS = [f"dup_chars_{n}" for n in GRAM_LIMITS]
MEASURES = [*BASE, *GRAMS, "dup_line_chars"]
RESULTS = [*MEASURES, "base_failed", "kept"]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of every word, its length in code points, and the words of each text."""
    known: dict[bytes, int] = {}
    parts, counts = [], np.zeros(len(texts), dtype=np.int64)
    for t, text in enumerate(texts):
        n = 0
        # a long text's words are never held as objects all at once
        for lo, hi in cuts(text, SLICE):
            words = text[lo:hi].split()
            parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words)))
            n += len(words)
        counts[t] = n
    sizes = np.fromiter((len(w.decode()) for w in known), dtype=np.int64, count=len(known))
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return ids, sizes[ids], counts


def mixed(ids: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of small numbers."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def found_twice(starts: np.ndarray, hashes: np.ndarray, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Those starts, ascending, whose window of n words comes again in the same text."""
    order = np.argsort(hashes, kind="stable")
    at = starts[order]
    same = hashes[order][1:] == hashes[order][:-1]
    a, b = at[1:][same], at[:-1][same]
    equal = owner[a] == owner[b]
    for k in range(n):
        equal &= ids[a + k] == ids[b + k]
    if not equal.all():
        # different windows share a hash: order all of them by their words instead
        order = np.lexsort([*(ids[starts + k] for k in range(n)), owner[starts]])
        at = starts[order]
        a, b = at[1:], at[:-1]
        equal = owner[a] == owner[b]
        for k in range(n):
            equal &= ids[a + k] == ids[b + k]
    twice = np.zeros(len(ids), dtype=bool)
    twice[a[equal]] = True
    twice[b[equal]] = True
    return np.flatnonzero(twice)


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether each of ``total`` words lies in a window of n words from one of the starts."""
    edges = np.zeros(total + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n, -1)
    return np.cumsum(edges[:-1]) > 0


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the characters of their words."""
    seen: dict[bytes, int] = {}
    n = chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
            if seen[line] < 0:
                seen[line] = sum(len(w.decode()) for w in line.split())
            chars += seen[line]
        elif line.strip():
            seen[line] = -1
    return n, chars


def measures(texts: list[bytes]) -> np.ndarray:
    """One row of ``MEASURES`` for each text."""
    out = np.zeros((len(texts), len(MEASURES)), dtype=np.int64)
    ids, sizes, counts = numbered(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    out[:, 0] = counts
    out[:, 1] = np.bincount(owner, sizes, len(texts))
    for t, text in enumerate(texts):
        out[t, 2] = len(text) - len(text.translate(None, SYMBOLS))
        out[t, 3], out[t, -1] = duplicate_lines(text)
    # how many words of the text begin at each word
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(ids))
    rolled = mixed(ids)
    start_value = rolled.copy()
    hashes = rolled + mixed(owner) * _STEP
    starts, length = np.arange(len(ids)), 1
    for n in sorted({*GRAM_LIMITS, REPEAT_WORDS}):
        while length < n:
            # every window takes in one word more, where its text still has one
            more = max(0, len(ids) - length)
            hashes[:more] = hashes[:more] * _STEP + start_value[len(ids) - more:]
            length += 1
        fits = starts[left[starts] >= n]
        starts = found_twice(fits, hashes[fits], ids, owner, n)
        inside = covered(starts, n, len(ids))
        if n in GRAM_LIMITS:
            out[:, len(BASE) + list(GRAM_LIMITS).index(n)] = np.bincount(owner[inside], sizes[inside], len(texts))
        if n == REPEAT_WORDS:
            out[:, 4] = np.bincount(owner[inside], minlength=len(texts))
    return out


def judged(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the base rules fail, and whether each row of ``measures`` is kept."""
    column = dict(zip(MEASURES, found.T))
    failed = (column["n_words"] < LEAST_WORDS) | (100 * column["n_repeat_words"] > REPEAT_LIMIT * column["n_words"])
    kept = ~failed & (100 * column["dup_line_chars"] <= LINE_LIMIT * column["word_chars"])
    for n, limit in GRAM_LIMITS.items():
        kept &= 100 * column[f"dup_chars_{n}"] <= limit * column["word_chars"]
    return failed, kept


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > SLICE:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def with_repetition(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The frame with the measures of every whole text, ``base_failed`` and ``kept``."""
    carried = [c for c in docs.columns if c not in RESULTS and (keep_text or c != text_col)]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(c, T.LongType()) for c in MEASURES]
                          + [T.StructField(c, T.BooleanType()) for c in RESULTS[len(MEASURES):]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch[text_col]]
            for lo, hi in slices(list(map(len, texts))):
                found = measures([t.encode() for t in texts[lo:hi]])
                new = dict(zip(MEASURES, found.T)) | dict(zip(RESULTS[len(MEASURES):], judged(found)))
                yield batch.iloc[lo:hi][carried].assign(**new)

    return docs.mapInPandas(run, schema)


def keep_unrepetitive(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep; all their columns stay."""
    here = [f"c{i}" for i in range(len(docs.columns))]
    found = with_repetition(docs.toDF(*here), here[docs.columns.index(text_col)]).where("kept")
    return found.select(*here).toDF(*docs.columns)


def op13_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_repetition(docs, keep_text=False).select("doc_id", *BASE, "base_failed", "kept", *GRAMS, "dup_line_chars")


def _gram_sql(n: int, name: str, value: str) -> str:
    """CTE with, per document, ``value`` summed over words in windows of n words found twice."""
    return f"""{name} AS (SELECT r, sum({value})::BIGINT AS x FROM (
    SELECT r, c, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM (
      SELECT r, i, c, CASE WHEN i + {n - 1} <= n AND count(*) OVER (PARTITION BY r, i + {n - 1} <= n, g) > 1 THEN 1 ELSE 0 END AS twice
      FROM (SELECT w.r, i, c, len(ws) AS n, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM w JOIN d USING (r))))
  WHERE inside = 1 GROUP BY r)"""


OP13_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
w AS MATERIALIZED (SELECT r, i, length(ws[i]) AS c FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
l AS (SELECT r, count(*) AS n, sum(c)::BIGINT AS c FROM (
    SELECT r, row_number() OVER (PARTITION BY r, line ORDER BY i) AS again,
           length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS c
    FROM (SELECT r, lines[i] AS line, i FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i
                                             FROM (SELECT r, string_split(t, chr(10)) AS lines FROM d))))
  WHERE again > 1 AND c > 0 GROUP BY r),
c AS (SELECT r, sum(c)::BIGINT AS x FROM w GROUP BY r),
{_gram_sql(REPEAT_WORDS, "rep", "1")},
{", ".join(_gram_sql(n, f"g{n}", "c") for n in GRAM_LIMITS)},
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c.x, 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.x, 0)::BIGINT AS n_repeat_words,
    {", ".join(f"coalesce(g{n}.x, 0)::BIGINT AS dup_chars_{n}" for n in GRAM_LIMITS)},
    coalesce(l.c, 0)::BIGINT AS dup_line_chars
  FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r)
  {" ".join(f"LEFT JOIN g{n} USING (r)" for n in GRAM_LIMITS)}),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars
  {" ".join(f"AND 100 * dup_chars_{n} <= {limit} * word_chars" for n, limit in GRAM_LIMITS.items())} AS kept FROM b
"""
