"""Regex patterns adapted to the JVM, with fast forms for ASCII-only text.

A pattern gets two JVM forms.  The exact form spells out the Unicode meaning of
``\\b``, ``\\d`` and ``\\s`` with explicit classes, so it does not depend on the
Java version.  The ASCII form uses the short escapes, which mean the same on
text without non-ASCII characters and run much faster.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
SPACE = (
    r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
SPACE_NOT_PLAIN = SPACE.replace(r"\x1c-\x20", r"\x1c-\x1f")
NON_ASCII = r"[^\x00-\x7F]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    The lambda variable keeps the optimizer from copying an expensive value into
    every place that uses it.
    """
    return F.transform(F.array(value), body)[0]


def exact(pattern: str, flags: str = "", word_edges: bool = False) -> str:
    """JVM form of a pattern.

    ``word_edges`` says that every ``\\b`` has a word character on its inner side,
    which leaves a single cheap look-around per boundary.
    """
    body = pattern
    if word_edges:
        body = re.sub(r"\\b(?=\(?(?:\?:)?(?:\w|\\d))", lambda _: f"(?<!{WORD})", body)
        body = re.sub(r"(?<=[\w)}?])\\b", lambda _: f"(?!{WORD})", body)
    body = (body.replace(r"\b", BOUNDARY)
                .replace(r"\d", r"\p{Nd}")
                .replace(r"\s", SPACE))
    return f"(?{flags}u)" * bool(flags) + body


def ascii_only(pattern: str, flags: str = "") -> str:
    body = pattern.replace(r"\s", r"[\x09-\x0d\x1c-\x20]")
    return f"(?{flags})" * bool(flags) + body


def is_ascii(text: Column) -> Column:
    return ~F.rlike(text, F.lit(NON_ASCII))


def matches(text: Column, pattern: str, flags: str = "", ascii_flag: Column | None = None,
            word_edges: bool = False) -> Column:
    """True where the pattern occurs in the text."""
    plain = is_ascii(text) if ascii_flag is None else ascii_flag
    return F.when(plain, F.rlike(text, F.lit(ascii_only(pattern, flags)))).otherwise(
        F.rlike(text, F.lit(exact(pattern, flags, word_edges))))


def quoted(literal: Column) -> Column:
    """A literal column as a quoted regex piece."""
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))


def folded(text: Column) -> Column:
    """Lower-case form for substring gates ahead of case-insensitive patterns."""
    odd = F.lit(False)
    for ch in "\u0131\u0130\u017f\u212a":
        odd = odd | F.contains(text, F.lit(ch))
    return F.lower(F.when(odd, F.translate(text, "\u0131\u0130\u017f\u212a", "iisk")).otherwise(text))
