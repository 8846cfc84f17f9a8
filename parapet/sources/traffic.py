"""Request and response bodies in the two API shapes, as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet import schemas
from parapet.operators.pii import SYSTEM_INDEX
from parapet.operators.verdicts import SYSTEM_ROLE

BLOCKS = "array<variant>"


def content_blocks(content: Column) -> Column:
    """Message content (a variant string or block list) as typed blocks.

    A string becomes one text block; blocks of other types keep their raw value.
    """
    as_list = F.try_variant_get(content, "$", BLOCKS)
    text_block = F.struct(F.lit("text").alias("type"), F.try_variant_get(content, "$", "string").alias("text"),
                          F.lit(None).cast("variant").alias("raw"))
    blocks = F.transform(as_list, lambda b: F.struct(
        F.try_variant_get(b, "$.type", "string").alias("type"),
        F.try_variant_get(b, "$.text", "string").alias("text"),
        F.when(F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit("")) != "text", b).alias("raw")))
    kind = F.schema_of_variant(content)
    return F.when(kind == "STRING", F.array(text_block)).when(
        F.startswith(kind, F.lit("ARRAY")), blocks).cast(schemas.CONTENT)


def requests_from_json(rows: DataFrame, body: str = "body") -> DataFrame:
    """Parse request bodies; other columns (id, time, headers, api) are kept.

    Adds ``stream``, ``system`` and ``messages`` (role, content, content_was_string).
    """
    d = rows.withColumn("__v", F.try_parse_json(F.col(body)))
    messages = F.transform(F.try_variant_get(F.col("__v"), "$.messages", BLOCKS), lambda m: F.struct(
        F.try_variant_get(m, "$.role", "string").alias("role"),
        content_blocks(F.try_variant_get(m, "$.content", "variant")).alias("content"),
        (F.schema_of_variant(F.try_variant_get(m, "$.content", "variant")) == "STRING").alias("content_was_string")))
    return d.select(
        *[c for c in rows.columns if c != body],
        F.coalesce(F.try_variant_get(F.col("__v"), "$.stream", "boolean"), F.lit(False)).alias("stream"),
        content_blocks(F.try_variant_get(F.col("__v"), "$.system", "variant")).alias("system"),
        F.coalesce(messages, F.array()).alias("messages"))


def message_rows(requests: DataFrame, keep: tuple[str, ...] = ("request_id", "tenant_id")) -> DataFrame:
    """One row per message, and one for a top-level system prompt."""
    rows = requests.select(*keep, F.posexplode("messages").alias("msg_idx", "m")).select(
        *keep, "msg_idx", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
    if "system" not in requests.columns:
        return rows
    system = requests.where(F.col("system").isNotNull()).select(
        *keep, F.lit(SYSTEM_INDEX).alias("msg_idx"), F.lit(SYSTEM_ROLE).alias("role"), F.col("system").alias("content"))
    return rows.unionByName(system)


def responses_from_json(rows: DataFrame, body: str = "body") -> DataFrame:
    """Response bodies of both shapes as (…, choice_idx, content, prompt_tokens, completion_tokens)."""
    rest = [c for c in rows.columns if c != body]
    d = rows.withColumn("__v", F.try_parse_json(F.col(body)))

    def count(a: str, b: str) -> Column:
        return F.coalesce(F.try_variant_get(F.col("__v"), f"$.usage.{a}", "long"),
                          F.try_variant_get(F.col("__v"), f"$.usage.{b}", "long"))

    usage = [count("prompt_tokens", "input_tokens").alias("prompt_tokens"),
             count("completion_tokens", "output_tokens").alias("completion_tokens")]
    choices = F.try_variant_get(F.col("__v"), "$.choices", BLOCKS)
    listed = d.where(choices.isNotNull()).select(*rest, *usage, F.posexplode(choices).alias("choice_idx", "c")).select(
        *rest, "choice_idx", content_blocks(F.try_variant_get(F.col("c"), "$.message.content", "variant")).alias("content"),
        "prompt_tokens", "completion_tokens")
    direct = d.where(choices.isNull()).select(
        *rest, F.lit(0).alias("choice_idx"),
        content_blocks(F.try_variant_get(F.col("__v"), "$.content", "variant")).alias("content"), *usage)
    return listed.unionByName(direct)
