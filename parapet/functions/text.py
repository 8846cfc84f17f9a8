"""Message text: block joins, header parsing, previews, normalisation, signing."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet import fixed_values as fv
from parapet.functions import patterns

# Characters that NFKC leaves alone whatever stands next to them: ASCII, plain
# Latin-1 and Latin Extended-A letters, common punctuation, Cyrillic letters,
# kana, unified ideographs and Hangul syllables.  The leading class skips the
# usual Latin text cheaply; the look-behind is only tried on what is left.
_NFKC_STABLE = (
    r"[^\x00-\x7FÀ-ı](?<![¡-§©«-®°±¶·»¿"
    r"Ĵ-ľŁ-ňŊ-žЀ-҂Ҋ-ӿ"
    r"​‐‒-‖‘-‣‧‰-′‵‹-※€"
    r"、。ぁ-ゖァ-ヺ一-鿿가-힣])"
)
_FOLDED_CHARS = (rf"[­ɡ-￯](?<=[{fv.HOMOGLYPHS_FROM}{fv.INVISIBLE}{fv.BIDI}])")
_BLANK_RUN = rf"(?: {patterns.SPACE}+|{patterns.SPACE_NOT_PLAIN}{patterns.SPACE}*+)"
_LEET_CHARS = r"[013457@$!]"


def text_blocks(content: Column) -> Column:
    return F.filter(content, lambda b: b["type"] == "text")


def message_text(content: Column) -> Column:
    """Text blocks of a message joined by one space; empty for missing content."""
    texts = F.transform(text_blocks(content), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.coalesce(F.array_join(texts, " "), F.lit(""))


def map_text(content: Column, f: Callable[[Column], Column]) -> Column:
    """Apply a text expression to every text block, leaving other blocks alone."""
    return F.transform(content, lambda b: F.when(
        b["type"] == "text",
        b.withField("text", f(F.coalesce(b["text"], F.lit("")))),
    ).otherwise(b))


def bearer_token(header: Column) -> Column:
    """Token of a ``Bearer`` header, trimmed; null for any other header."""
    edge = patterns.SPACE
    token = F.substr(header, F.lit(8))
    return F.when(
        F.lower(F.substring(header, 1, 7)) == "bearer ",
        F.regexp_replace(token, f"^{edge}+|{edge}+$", ""),
    )


def message_preview(messages: Column, n: int = 200) -> Column:
    """First non-empty text of the last message that has one, cut to ``n``."""
    firsts = F.transform(messages, lambda m: F.get(F.filter(
        F.transform(text_blocks(m["content"]), lambda b: b["text"]),
        lambda t: t != ""), F.lit(0)))
    last = F.get(F.filter(F.reverse(firsts), lambda t: t.isNotNull()), F.lit(0))
    return F.coalesce(F.substring(last, 1, n), F.lit(""))


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):
        return texts
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """NFKC form.  Only text that could change is handed to the Python worker."""
    changed = _nfkc(F.when(F.rlike(text, F.lit(_NFKC_STABLE)), text))
    return F.coalesce(changed, text)


def fold_letters(text: Column) -> Column:
    """Drop invisible and direction marks and fold lookalike letters."""
    return F.when(
        F.rlike(text, F.lit(_FOLDED_CHARS)),
        F.translate(text, fv.HOMOGLYPHS_FROM + fv.INVISIBLE + fv.BIDI, fv.HOMOGLYPHS_TO),
    ).otherwise(text)


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, _BLANK_RUN, " ")


def normalize_text(text: Column) -> Column:
    return collapse_blanks(fold_letters(nfkc(text)))


def leet_fold(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(_LEET_CHARS)),
                  F.translate(text, fv.LEET_FROM, fv.LEET_TO)).otherwise(text)


def hmac_sha256(secret: Column, body: Column) -> Column:
    """Hex HMAC-SHA256 of a UTF-8 body; null if the secret is null."""
    key = F.encode(secret, "UTF-8")
    key = F.when(F.octet_length(secret) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    codes = F.rpad(F.hex(key), 128, "0")

    def padded(mask: int) -> Column:
        # xor with a constant byte, one hex digit at a time through translate
        high, low = mask >> 4, mask & 15
        digits = "0123456789ABCDEF"
        def swap(x: int) -> str:
            return "".join(digits[int(d, 16) ^ x] for d in digits)
        pairs = F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: F.concat(
                F.translate(F.substr(codes, i * 2 + 1, F.lit(1)), digits, swap(high)),
                F.translate(F.substr(codes, i * 2 + 2, F.lit(1)), digits, swap(low))),
        )
        return F.unhex(F.array_join(pairs, ""))

    inner = F.unhex(F.sha2(F.concat(padded(0x36), F.encode(body, "UTF-8")), 256))
    return F.sha2(F.concat(padded(0x5C), inner), 256)
