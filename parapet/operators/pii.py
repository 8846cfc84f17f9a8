"""Personal data across messages: tokens with a vault, restoring, profiles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions import numbers, pii
from parapet.operators.folds import written
from parapet.operators.scan import running

# Message index of a top-level system prompt: it is handled after all messages.
SYSTEM_INDEX = 2_147_483_647
TEXT_KEYS = ["request_id", "msg_idx", "block_idx"]


class Tokenized(NamedTuple):
    texts: DataFrame
    vault: DataFrame


def text_rows(messages: DataFrame) -> DataFrame:
    """One row per text block: (request_id, msg_idx, block_idx, text) and any other columns."""
    rest = [c for c in messages.columns if c != "content"]
    return (messages.select(*rest, F.posexplode("content").alias("block_idx", "block"))
            .where(F.col("block.type") == "text")
            .select(*rest, "block_idx", F.coalesce("block.text", F.lit("")).alias("text")))


def _numbered(events: DataFrame) -> DataFrame:
    """Token number of each first appearance.

    ``events`` mixes first appearances of values and token literals found in texts
    with personal data.  In order, value k gets k + max(0, n - c) over the literals
    before it, n being the literal's number and c the values counted before it.
    """
    keys, order = ["request_id", "ptype"], ["msg_idx", "block_idx", "s", "n"]
    # one text is one row, so a range of messages is a bounded block
    block = F.floor(F.col("msg_idx") / 64)
    d = running(events, keys, order, block, sums={"k": F.col("is_value").cast("bigint")})
    lift = F.when(~F.col("is_value"), numbers.plus(F.col("n"), -F.col("k")))
    d = running(d, keys, order, block, maxes={"lift": lift})
    return d.where("is_value").withColumn(
        "number", numbers.plus(F.coalesce("lift", numbers.zero()), F.col("k")))


def tokenize_pii(texts: DataFrame, types: Column | list[str] | None = None,
                 safe_reserve: bool = False, positions: bool = False) -> Tokenized:
    """Replace each value by a token that is unique within its request.

    A token depends on texts before it alone.  ``positions`` adds the message of its first
    appearance to the vault, so that the vault of any prefix is the rows before its end.

    Texts without possible matches pass straight through.  The text of the others
    is shuffled once, to meet its tokens; numbering only moves matches.
    ``safe_reserve`` keeps tokens clear of literals anywhere in the request.
    """
    maybe = F.coalesce(pii.may_hold_pii(F.col("text")), F.lit(False))
    plain, near = texts.where(~maybe), texts.where(maybe)
    # matches are few and small next to the texts: written once, numbered from there
    marks = written(near.select(*TEXT_KEYS, pii.pii_spans(F.col("text"), types).alias("spans"),
                                pii.token_literals(F.col("text")).alias("literals")).where(F.size("spans") > 0))
    found = marks.select(*TEXT_KEYS, F.explode("spans").alias("x")).select(*TEXT_KEYS, "x.*")
    at = F.struct("msg_idx", "block_idx", "s")
    firsts = found.groupBy("request_id", "ptype", "value").agg(F.min(at).alias("at")).select(
        "request_id", "ptype", "value", "at.*", F.lit(None).cast(numbers.KIND).alias("n"),
        F.lit(True).alias("is_value"))
    if safe_reserve:
        every = texts.where(F.contains("text", F.lit("[PII_"))).select(
            "request_id", F.lit(-1).alias("msg_idx"), F.lit(0).alias("block_idx"),
            pii.token_literals(F.col("text")).alias("literals"))
    else:
        every = marks.select(*TEXT_KEYS, "literals")
    literals = every.select("request_id", "msg_idx", "block_idx", F.explode("literals").alias("t")).select(
        "request_id", F.col("t.ptype").alias("ptype"), F.lit(None).cast("string").alias("value"),
        F.col("msg_idx").cast(texts.schema["msg_idx"].dataType).alias("msg_idx"),
        F.col("block_idx").cast(texts.schema["block_idx"].dataType).alias("block_idx"),
        F.lit(-1).alias("s"), F.col("t.n").alias("n"), F.lit(False).alias("is_value")).where(F.col("n").isNotNull())
    numbered = _numbered(firsts.unionByName(literals))
    vault = numbered.select(
        "request_id", F.concat(F.lit("[PII_"), F.upper("ptype"), F.lit("_"), numbers.to_string(F.col("number")),
                               F.lit("]")).alias("token"), "ptype", "value", *(["msg_idx"] if positions else []))
    # per text: at most as many tokens as the text has matches
    tokens = found.join(vault.drop("msg_idx"), ["request_id", "ptype", "value"]).groupBy(*TEXT_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("s", "e", "token"))).alias("__tokens"))
    rewritten = near.join(tokens, TEXT_KEYS, "left")
    rewritten = rewritten.withColumn("text", F.when(
        F.col("__tokens").isNotNull(),
        pii.replace_spans(F.col("text"), F.col("__tokens"), lambda x: x["token"])).otherwise(F.col("text")))
    return Tokenized(plain.unionByName(rewritten.drop("__tokens")), vault)


def restore_texts(texts: DataFrame, vault: DataFrame, keys: list[str], owner: str = "request_id",
                  column: str = "text") -> DataFrame:
    """Put vault values back into texts, one row per ``keys``.

    Only rows that hold a token-shaped string are shuffled, and each meets only
    the tokens it names: a request's vault is never gathered in one place.
    """
    holds = F.coalesce(F.contains(F.col(column), F.lit("[PII_")), F.lit(False))
    plain, tokened = texts.where(~holds), texts.where(holds)
    if owner not in keys:
        keys = [owner, *keys]
    wanted = tokened.select(*keys, F.explode(pii.text_tokens(F.col(column))).alias("token"))
    known = wanted.join(vault.select(F.col("request_id").alias(owner), "token", "value"), [owner, "token"])
    values = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("__vault"))
    done = tokened.join(values, keys, "left").withColumn(
        column, pii.restore_tokens(F.col(column), F.col("__vault"))).drop("__vault")
    return plain.unionByName(done)


def restore_responses(responses: DataFrame, vault: DataFrame, owner: str = "request_id", upto: str | None = None) -> DataFrame:
    """Responses (request_id, choice_idx, content) with the vault's values put back.

    Same plan as ``restore_texts``, on content blocks.  ``owner`` names whose vault a
    response has; of a vault with positions it knows the tokens before ``upto``.
    """
    keys = ["request_id", "choice_idx"]
    texts = F.filter(F.col("content"), lambda b: (b["type"] == "text") & F.contains(b["text"], F.lit("[PII_")))
    holds = F.coalesce(F.size(texts) > 0, F.lit(False))
    plain, tokened = responses.where(~holds), responses.where(holds)
    tokens = F.array_distinct(F.flatten(F.transform(texts, lambda b: pii.text_tokens(b["text"]))))
    wanted = tokened.select(*keys, F.col(owner).alias("__owner"), *([F.col(upto).alias("__upto")] if upto else []),
                            F.explode(tokens).alias("token"))
    held = vault.select(F.col("request_id").alias("__owner"), "token", "value", *(["msg_idx"] if upto else []))
    known = wanted.join(held, ["__owner", "token"])
    if upto:
        known = known.where(F.col("msg_idx") < F.col("__upto"))
    values = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("__vault"))
    content = F.transform("content", lambda b: F.when(
        b["type"] == "text", b.withField("text", pii.restore_tokens(b["text"], F.col("__vault")))).otherwise(b))
    done = tokened.join(values, keys, "left").withColumn("content", content).drop("__vault")
    return plain.unionByName(done)


def pii_profile(texts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Match and text counts per type."""
    spans = texts.where(pii.may_hold_pii(F.col("text"))).select(pii.pii_spans(F.col("text"), types).alias("x"))
    per_text = spans.select(F.explode(pii.span_types(F.col("x"))).alias("ptype"), "x").select(
        "ptype", F.size(F.filter("x", lambda s: s["ptype"] == F.col("ptype"))).alias("n"))
    return per_text.groupBy("ptype").agg(F.sum("n").alias("matches"), F.count("*").alias("texts"))


def type_mask(spans: Column) -> Column:
    """Types of a span array as bits, in alphabetical order of type name."""
    names = sorted(pii.TYPES)
    total = F.lit(0)
    for i, name in enumerate(names):
        total = total + F.when(F.exists(spans, lambda s: s["ptype"] == name), 1 << i).otherwise(0)
    return total


def mask_types(mask: Column) -> Column:
    names = sorted(pii.TYPES)
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(names)]))
