"""Preference formatting: a shared prompt and two masked completions.

The longest common turn prefix of the chosen and the rejected conversation is rendered
once as the prompt; what follows on either side is its completion.  Masks are given as
spans of the whole text (prompt and completion): the characters that a model should learn, which are
the replies of the assistant after the prompt, each with its end mark.

Defined results: null roles and texts count as empty; ``<|`` in a text becomes ``< |``, so
that no text can pretend to be a mark; null turn lists are empty; equal conversations
give two empty completions; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.texts import table

LEARNED = "assistant"
END = "<|end|>\n"


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def body(text: Column) -> Column:
    return F.concat(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t["role"]), body(t["text"]))), "")


def plain(turns: Column) -> Column:
    """Turns as (role, text) without nulls."""
    empty = F.array().cast("array<struct<role:string,text:string>>")
    return F.coalesce(F.transform(turns, lambda t: F.struct(
        F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))), empty)


def prefix_length(a: Column, b: Column) -> Column:
    """Number of turns that both begin with."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def learned_spans(turns: Column, start: Column) -> Column:
    """Spans of the learned replies in text that begins at ``start``, as ``a-b,c-d``."""
    state = F.struct(start.cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(head(t["role"]))
        end = begin + F.length(body(t["text"]))
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == LEARNED, F.concat(s["spans"], F.array(span)))
                        .otherwise(s["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, state, add)["spans"], ",")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Frame with two columns of turns -> both replaced by completions, with n_prefix, prompt and spans."""
    new = ["n_prefix", "prompt", chosen, rejected, f"{chosen}_spans", f"{rejected}_spans"]
    kept = [c for c in pairs.columns if c not in new]
    d = pairs.select(*kept, plain(F.col(chosen)).alias("__a"), plain(F.col(rejected)).alias("__b"))
    d = d.withColumn("n_prefix", prefix_length(F.col("__a"), F.col("__b")))
    d = d.withColumn("prompt", rendered(F.slice("__a", F.lit(1), F.col("n_prefix"))))
    rest = {c: F.slice(x, F.col("n_prefix") + 1, F.greatest(F.size(x) - F.col("n_prefix"), F.lit(0)))
            for c, x in ((chosen, "__a"), (rejected, "__b"))}
    return d.select(*kept, "n_prefix", "prompt", *(rendered(x).alias(c) for c, x in rest.items()),
                    *(learned_spans(x, F.length("prompt")).alias(f"{c}_spans") for c, x in rest.items()))


def reply_pairs(turns: DataFrame) -> DataFrame:
    """Pairs out of plain conversations: each up to its last reply, against the same with a neighbour's last reply.

    Neighbours are the conversations 2k and 2k + 1; without one the other reply is empty.  A
    conversation without a reply stands on both sides.  One shuffle brings neighbours together.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = F.coalesce(F.pmod("conv_id", F.lit(2)), F.lit(0))
    sides = [F.sort_array(F.collect_list(F.when(side == k, turn))).alias(f"s{k}") for k in (0, 1)]
    couple = turns.groupBy(F.floor(F.col("conv_id") / 2).alias("k")).agg(*sides)
    last = lambda c: F.array_max(F.transform(c, lambda t, i: F.when(t["role"] == LEARNED, i + 1)))
    couple = couple.select("k", *(F.transform(f"s{k}", lambda t: t.dropFields("turn")).alias(f"s{k}") for k in (0, 1)),
                           *(F.coalesce(last(F.col(f"s{k}")), F.lit(0)).alias(f"l{k}") for k in (0, 1)))
    rows = F.array(*(F.struct(
        (F.col("k") * 2 + k).alias("conv_id"), F.col(f"s{k}").alias("own"), F.col(f"l{k}").alias("last"),
        F.when(F.col(f"l{1 - k}") > 0, F.element_at(f"s{1 - k}", F.greatest(F.col(f"l{1 - k}"), F.lit(1)))["text"])
        .otherwise("").alias("other")) for k in (0, 1)))
    d = couple.select(F.explode(rows).alias("r")).select("r.*").where(F.size("own") > 0)
    context = F.slice("own", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0)))
    reply = F.array(F.struct(F.lit(LEARNED).alias("role"), F.col("other").alias("text")))
    return d.select("conv_id", F.when(F.col("last") > 0, F.slice("own", F.lit(1), F.col("last"))).otherwise(F.col("own")).alias("chosen"),
                    F.when(F.col("last") > 0, F.concat(context, reply)).otherwise(F.col("own")).alias("rejected"))


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completions of every conversation and its neighbour's reply."""
    return format_preferences(reply_pairs(table(spark, sf_dir, "conversations")))


OP1_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  '<|' || coalesce(role, '') || '|>' || chr(10) AS h, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS b,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations),
l AS (SELECT conv_id, max(i) AS n, max(i) FILTER (role = 'assistant') AS last FROM t GROUP BY conv_id),
r AS (SELECT t.conv_id, t.text, t.b FROM t JOIN l ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.last),
p AS (SELECT l.conv_id, l.n, l.last, r.text AS own, r.b AS own_b, coalesce(o.text, '') AS other,
             coalesce(o.b, '<|end|>' || chr(10)) AS other_b,
             CASE WHEN l.last IS NULL THEN l.n WHEN r.text = coalesce(o.text, '') THEN l.last ELSE l.last - 1 END AS k
      FROM l LEFT JOIN r ON l.conv_id IS NOT DISTINCT FROM r.conv_id
             LEFT JOIN r o ON o.conv_id = CASE WHEN l.conv_id % 2 = 0 THEN l.conv_id + 1 ELSE l.conv_id - 1 END),
q AS (SELECT p.*, coalesce((SELECT string_agg(t.h || t.b, '' ORDER BY t.i) FROM t
                            WHERE t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i <= p.k), '') AS prompt FROM p),
c AS (SELECT *, last IS NOT NULL AND k < last AS two, '<|assistant|>' || chr(10) AS h FROM q)
SELECT conv_id, k::INTEGER AS n_prefix, prompt, CASE WHEN two THEN h || own_b ELSE '' END AS chosen,
       CASE WHEN two THEN h || other_b ELSE '' END AS rejected,
       CASE WHEN two THEN (length(prompt) + length(h)) || '-' || (length(prompt) + length(h) + length(own_b)) ELSE '' END AS chosen_spans,
       CASE WHEN two THEN (length(prompt) + length(h)) || '-' || (length(prompt) + length(h) + length(other_b)) ELSE '' END AS rejected_spans
FROM c
"""
