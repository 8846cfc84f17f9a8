"""Personal-data spans in a text, and the rewrites built on them.

All of it is row-local: no shuffle, no Python worker.  Number patterns and the
e-mail pattern only run on rows that can contain a match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet import fixed_values as fv
from parapet.functions import numbers, patterns

TYPES = list(fv.PII_PATTERNS)
SPAN_ARRAY = "array<struct<s:int,e:int,ptype:string,value:string>>"
DIGIT_RUN = r"\p{Nd}{3}"


def may_hold_pii(text: Column) -> Column:
    """Cheap test that every text with a match passes."""
    return (F.instr(text, "@") > 0) | F.rlike(text, F.lit(DIGIT_RUN))


#: up to so many items an array is walked plainly
FEW = 48


def _parts(items: Column, root: int) -> Column:
    """An array cut into consecutive parts, each about as long as the given root of its size."""
    size = F.ceil(F.pow(F.size(items).cast("double"), F.lit(1 / root))).cast("int")
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, size))


def _running(items: Column, merge, zero: int) -> Column:
    """Running merges (sums, maxima) of an array of numbers.

    Appending to an array copies it, so only short arrays are walked item by item; a long one is cut
    into parts, whose running values start from what the parts before add up to.
    """
    def step(acc: Column, x: Column) -> Column:
        last = merge(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(zero)), x)
        return F.concat(acc, F.array(last))

    def plain(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), step)

    def joined(x: Column) -> Column:
        return F.flatten(F.transform(x["parts"], lambda p, k: F.transform(
            p, lambda v: merge(F.coalesce(F.get(x["ends"], k - 1), F.lit(zero)), v))))

    def long(bound: Column) -> Column:
        ends = lambda own: plain(F.transform(own, lambda p: F.element_at(p, -1)))
        return patterns.let(F.transform(_parts(bound, 3), plain), lambda own: patterns.let(
            F.struct(own.alias("parts"), ends(own).alias("ends")), joined))

    # bound once: what stands inside a lambda is worked out anew for every item
    return patterns.let(items, lambda bound: F.when(F.size(bound) <= FEW, plain(bound)).otherwise(long(bound)))


def _located(text: Column, pattern: Column, ptype: str) -> Column:
    """All left-to-right matches of one pattern with their offsets."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def placed(x: Column) -> Column:
        steps = F.zip_with(x["f"], F.slice(x["g"], F.lit(1), F.size(x["f"])), lambda h, g: F.length(g) + F.length(h))
        return patterns.let(_running(steps, lambda a, b: a + b, 0), lambda ends: F.transform(x["f"], lambda h, i: F.struct(
            (F.get(ends, i) - F.length(h)).alias("s"), F.get(ends, i).alias("e"), F.lit(ptype).alias("ptype"), h.alias("value"))))

    return patterns.let(found, lambda f: F.when(F.size(f) > 0, patterns.let(
        F.struct(f.alias("f"), F.split(text, pattern, -1).alias("g")), placed)).otherwise(F.array().cast(SPAN_ARRAY)))


def _gate(text: Column, ptype: str) -> Column:
    if ptype == "email":
        return F.instr(text, "@") > 0
    if ptype == "credit_card":
        return F.rlike(text, F.lit(r"[0-9]{13}"))
    return F.rlike(text, F.lit(DIGIT_RUN))


def pii_spans(text: Column, types: Column | list[str] | None = None) -> Column:
    """Non-overlapping spans in text order; earlier types claim text first.

    ``types`` may be a column, so that each row can carry its tenant's choice.
    """
    if isinstance(types, (list, tuple)):
        types = F.array(*[F.lit(t) for t in types]).cast("array<string>")
    none = F.array().cast(SPAN_ARRAY)
    every = []
    for ptype in TYPES:
        wanted = _gate(text, ptype)
        if types is not None:
            wanted = F.array_contains(types, ptype) & wanted
        # a constant pattern is compiled once per task
        pattern = F.lit(patterns.exact(fv.PII_PATTERNS[ptype], word_edges=True))
        hits = F.when(wanted, _located(text, pattern, ptype)).otherwise(none)
        if ptype == "credit_card":
            hits = F.filter(hits, lambda h: F.call_function("luhn_check", h["value"]))
        every.append(hits)
    found = patterns.let(F.sort_array(F.concat(*every)), lambda x: F.when(
        F.size(x) <= FEW, F.sort_array(_claimed(x))).otherwise(F.flatten(F.transform(_clusters(x), lambda c: F.when(F.size(c) > 1, F.sort_array(_claimed(c))).otherwise(c)))))
    return F.when(may_hold_pii(text), found).otherwise(F.when(text.isNotNull(), none))


def _claimed(spans: Column) -> Column:
    """What is left of a few spans when each type, in its turn, claims those that overlap no claimed one."""
    def claim(got: Column, ptype: str) -> Column:
        return patterns.let(got, lambda g: F.concat(g, F.filter(spans, lambda h: (h["ptype"] == ptype) & ~F.exists(
            g, lambda c: (c["s"] < h["e"]) & (h["s"] < c["e"])))))

    got = F.filter(spans, lambda h: h["ptype"] == TYPES[0])
    for ptype in TYPES[1:]:
        got = claim(got, ptype)
    return F.when(F.size(spans) > 1, got).otherwise(spans)


def _clusters(spans: Column) -> Column:
    """Sorted spans cut wherever a span begins at or after the end of all before it."""
    def cut(ends: Column) -> Column:
        first = F.filter(F.transform(spans, lambda h, i: F.when(F.coalesce(F.get(ends, i - 1), F.lit(0)) <= h["s"], i)), lambda i: i.isNotNull())
        return patterns.let(first, lambda at: F.transform(at, lambda i, k: F.slice(
            spans, i + 1, F.coalesce(F.get(at, k + 1), F.size(spans)) - i)))

    return patterns.let(_running(F.transform(spans, lambda h: h["e"]), F.greatest, 0), cut)


def replace_spans(text: Column, spans: Column, replacement) -> Column:
    """Rebuild a text with every span replaced by ``replacement(span)``.

    Cutting a piece out walks the text up to it, so a text with many spans is first cut into parts.
    """
    def rebuilt(part: Column, lo: Column, group: Column) -> Column:
        """Text from ``lo``, where ``part`` begins, to the end of the group's last span."""
        def piece(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(group, i - 1)["e"], lo)
            return F.concat(F.substring(part, at - lo + 1, s["s"] - at), replacement(s))
        return F.array_join(F.transform(group, piece), "")

    def in_parts(groups: Column) -> Column:
        cut = F.transform(groups, lambda g, k: F.struct(
            F.coalesce(F.element_at(F.get(groups, k - 1), -1)["e"], F.lit(0)).alias("lo"), g.alias("g")))
        return F.array_join(F.transform(cut, lambda x: patterns.let(
            F.substring(text, x["lo"] + 1, F.element_at(x["g"], -1)["e"] - x["lo"]), lambda own: rebuilt(own, x["lo"], x["g"]))), "")

    long = patterns.let(_parts(spans, 2), in_parts)
    whole = F.concat(F.when(F.size(spans) <= FEW, rebuilt(text, F.lit(0), spans)).otherwise(long), F.substr(text, F.element_at(spans, -1)["e"] + 1))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def placeholder(span: Column) -> Column:
    out = F.lit(None).cast("string")
    for ptype, label in fv.PII_PLACEHOLDERS.items():
        out = F.when(span["ptype"] == ptype, F.lit(label)).otherwise(out)
    return out


def redact_spans(text: Column, spans: Column) -> Column:
    return replace_spans(text, spans, placeholder)


def redact_pii(text: Column, types: Column | list[str] | None = None) -> Column:
    """The text with each match replaced by its fixed placeholder."""
    return patterns.let(pii_spans(text, types), lambda spans: redact_spans(text, spans))


def pii_types(text: Column, types: Column | list[str] | None = None) -> Column:
    """Sorted distinct types found."""
    return span_types(pii_spans(text, types))


def span_types(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["ptype"])))


def block_reason(types: Column) -> Column:
    return F.concat(F.lit("Request contains PII: "), F.array_join(types, ", "))


def token_literals(text: Column) -> Column:
    """Token-shaped strings of a text as (ptype, n), n as in ``functions.numbers``."""
    whole = F.regexp_extract_all(text, F.lit(patterns.exact(fv.TOKEN_PATTERN)), F.lit(0))
    return F.transform(whole, lambda t: F.struct(
        F.lower(F.regexp_extract(t, patterns.exact(fv.TOKEN_PATTERN), 1)).alias("ptype"),
        numbers.from_digits(F.regexp_extract(t, patterns.exact(fv.TOKEN_PATTERN), 2)).alias("n")))


def text_tokens(text: Column) -> Column:
    """Distinct token-shaped strings of a text."""
    return F.array_distinct(
        F.regexp_extract_all(text, F.lit(patterns.exact(fv.TOKEN_PATTERN)), F.lit(0)))


def restore_tokens(text: Column, vault: Column) -> Column:
    """Replace known tokens by their values; unknown tokens stay as they are."""
    pattern = F.lit(patterns.exact(fv.TOKEN_PATTERN))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = F.transform(found, lambda t: F.coalesce(F.try_element_at(vault, t), t))
    pieces = F.zip_with(gaps, values, lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    return F.when(vault.isNull() | ~F.contains(text, F.lit("[PII_")), text).otherwise(
        F.array_join(pieces, ""))
