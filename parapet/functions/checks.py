"""Row-local checks of response text: length, JSON shape, toxicity, topics."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet import fixed_values as fv
from parapet.functions import patterns

SCHEMA_DDL = "struct<required:array<string>,properties:string>"
VARIANT_MAP = "map<string,variant>"


def length_error(text: Column, limit: Column | int | None) -> Column:
    """Reason where the text is longer than a set, non-zero limit."""
    limit = limit if isinstance(limit, Column) else F.lit(limit).cast("int")
    return F.when((limit != 0) & (F.length(text) > limit), F.concat(
        F.lit("Response exceeds max length ("), F.length(text).cast("string"), F.lit(" > "),
        limit.cast("string"), F.lit(" chars)")))


def parsed_json(text: Column) -> Column:
    """The text as a variant; null unless the whole text is one JSON value."""
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"r":'), text, F.lit("}")))
    return F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$.r", "variant"))


#: Pieces of a JSON text: strings, what lies between them, and quotes that open no string.
_PIECES = r'(?s)"(?:[^"\\]|\\.)*+"|[^"]++|"'
_ALONE, _ENDS = r"(?<![\w.+-])", r"(?![\w.])"
_WHOLE = r"-?(?:0|[1-9][0-9]*+)"
_INTEGER = _ALONE + _WHOLE + r"(?![\w.])"
_FLOAT = _ALONE + "(?:NaN|-?Infinity|" + _WHOLE + r"(?:\.[0-9]+(?:[eE][-+]?[0-9]+)?|[eE][-+]?[0-9]+))" + _ENDS


def json_shape(text: Column) -> Column:
    """The text as a variant whose numbers only keep their kind; null unless it is one JSON value.

    A number's kind is read off its spelling, so integers of any length are integers, and ``NaN``,
    ``Infinity`` and ``-Infinity`` are floats.
    """
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    plain = F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit('"')), p).otherwise(
        F.regexp_replace(F.regexp_replace(p, _INTEGER, "7"), _FLOAT, "0.5")))
    return parsed_json(F.array_join(plain, ""))


def json_type(value: Column) -> Column:
    """Type name of a value of ``json_shape``: string, integer, float, boolean, array, object, null."""
    kind = F.schema_of_variant(value)
    return (F.when(kind == "VOID", "null")
            .when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "boolean")
            .when(kind == "BIGINT", "integer")
            .when(F.rlike(kind, F.lit("^(DECIMAL|DOUBLE|FLOAT)")), "float")
            .when(F.startswith(kind, F.lit("ARRAY")), "array")
            .when(F.startswith(kind, F.lit("OBJECT")), "object"))


def _accepts(expected: Column, actual: Column) -> Column:
    return (F.when(expected == "number", actual.isin("integer", "float", "boolean"))
            .when(expected == "integer", actual.isin("integer", "boolean"))
            .when(expected.isin("string", "boolean", "array", "object"), actual == expected)
            .otherwise(True))


def schema_error(text: Column, schema: dict | Column | None) -> Column:
    """First violation of a small JSON schema (required keys, property types).

    ``schema`` is a dict, or a column holding schema text so that each row can
    follow its tenant's schema.  Null or an empty object means no check.
    """
    if schema is None or isinstance(schema, dict):
        schema = F.lit(json.dumps(schema) if schema else None).cast("string")
    active = schema.isNotNull() & ~F.rlike(schema, F.lit(r"^\s*(\{\s*\}|null)\s*$"))
    parts = F.from_json(schema, SCHEMA_DDL)
    rules = F.from_json(F.get_json_object(schema, "$.properties"), "map<string,string>")
    bound = F.struct(json_shape(text).alias("v"), parts["required"].alias("required"),
                     rules.alias("rules"))

    def check(b: Column) -> Column:
        fields = F.try_variant_get(b["v"], "$", VARIANT_MAP)
        missing = F.get(F.filter(
            b["required"], lambda k: ~F.coalesce(F.map_contains_key(fields, k), F.lit(False))), F.lit(0))
        wrong = F.get(F.filter(
            F.transform(F.map_entries(b["rules"]), lambda r: F.struct(
                r["key"].alias("k"), F.get_json_object(r["value"], "$.type").alias("t"))),
            lambda r: F.coalesce(F.map_contains_key(fields, r["k"]), F.lit(False)) & r["t"].isNotNull()
            & ~_accepts(r["t"], json_type(F.try_element_at(fields, r["k"])))), F.lit(0))
        return (F.when(b["v"].isNull(), F.lit("Response is not valid JSON (schema validation required)"))
                .when(json_type(b["v"]) != "object", F.lit("expected object at root"))
                .when(missing.isNotNull(), F.concat(F.lit("missing required field: '"), missing, F.lit("'")))
                .when(wrong.isNotNull(), F.concat(
                    F.lit("field '"), wrong["k"], F.lit("' expected type "), wrong["t"])))

    return F.when(active, patterns.let(bound, check))


def output_error(text: Column, limit: Column | int | None, schema: dict | Column | None) -> Column:
    return F.coalesce(length_error(text, limit), schema_error(text, schema))


def toxic_words(text: Column) -> Column:
    """True where a word-list pattern occurs."""
    plain = patterns.is_ascii(text)
    found = F.lit(False)
    for pattern in fv.TOXICITY_PATTERNS:
        found = found | patterns.matches(text, pattern, "i", plain, word_edges=True)
    return found


def toxicity_error(text: Column, provider: Column, enabled: Column, threshold: Column,
                   flagged: Column, categories: Column, score: Column) -> Column:
    """Reason by the tenant's provider; missing scores and unknown providers pass."""
    hits = F.map_keys(F.map_filter(categories, lambda _, hit: hit))
    by_words = F.when(toxic_words(text), F.lit("Response contains toxic content"))
    by_flags = F.when(flagged, F.concat(
        F.lit("Content flagged by moderation API: "), F.array_join(F.coalesce(hits, F.array()), ", ")))
    by_score = F.when(score >= threshold, F.concat(
        F.lit("Content flagged as toxic (score: "), two_decimals(score),
        F.lit(", threshold: "), threshold.cast("string"), F.lit(")")))
    return F.when(enabled & (text != ""), F.when(provider == "wordlist", by_words)
                  .when(provider == "openai", by_flags)
                  .when(provider == "perspective", by_score))


def two_decimals(score: Column) -> Column:
    """A score with two decimals, rounded by its exact binary value, a true half to even.

    A double below 4 times 2^60 is a whole number (smaller parts cannot reach half a
    hundredth), so hundredths and the rest come from whole-number arithmetic.
    """
    whole = (F.abs(score) * float(1 << 60)).cast("bigint").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    unit = F.lit(1 << 60).cast("decimal(20,0)")

    def rounded(parts: Column) -> Column:
        q, rest = parts["q"], parts["rest"] * 2
        up = (rest > unit) | ((rest == unit) & (q % 2 == 1))
        n = q + up.cast("bigint")
        return F.concat(F.when(score < 0, "-").otherwise(""), F.floor(n / 100).cast("string"), F.lit("."),
                        F.lpad((n % 100).cast("string"), 2, "0"))

    exact = patterns.let(whole, lambda w: patterns.let(
        F.struct(F.call_function("div", w, unit).cast("bigint").alias("q"), (w % unit).alias("rest")), rounded))
    return F.when(F.abs(score) < 4, exact).otherwise(F.format_string("%.2f", score))


def topic_pattern(topic: Column) -> Column:
    return F.concat(F.lit("(?iu)" + patterns.BOUNDARY), patterns.quoted(topic), F.lit(patterns.BOUNDARY))


def topics_found(text: Column, topics: Column) -> Column:
    """Positions (from 0) in the topic list of the topics a text mentions.

    A plain substring test comes first, so the regex is only built for rows
    that nearly match; topics are lower-case already.
    """
    numbered = F.transform(topics, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    near = patterns.let(patterns.folded(text), lambda low: F.filter(
        numbered, lambda n: F.rlike(n["t"], F.lit(patterns.NON_ASCII)) | F.contains(low, n["t"])))
    hits = F.filter(near, lambda n: F.rlike(text, topic_pattern(n["t"])))
    return F.transform(hits, lambda n: n["i"])
