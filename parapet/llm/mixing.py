"""Mixing sources to target weights with hash-random keys and prefix sums.

Every document gets a hash-random key from its id and text.  Within a source, the
top bits of the key cut the key range into buckets; rows are sorted inside their
bucket, bucket totals are summed into offsets, and offset plus running sum gives each
document's place on the source's line of words, whatever the size of the source.  The
source's budget is laid over that line: whole epochs first, then the line is cut at
exactly the budget that is left, so at most one document of a source is taken in part.

Defined results: null and wordless texts have size 0 and nothing of them is taken;
a null source is a source of its own that comes last; rows with the same id and text
are interchangeable; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parapet.llm.texts import WORDS, apart, placed, table, word_count
from parapet.storage import written

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: ranges of the key in a source; a range of a source must fit the sort of one task
KEY_RANGES = 1024
HELPERS = ["_s", "_key", "_bucket", "_words"]


def keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> list:
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"),
                         F.coalesce(F.col(text_col), F.lit(""))))
    return [F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("s"), source_col)).alias("_s"),
            key.alias("_key"), word_count(F.col(text_col)).alias("_words")]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """_s, source_size -> the same with ``target``: shares by weight, capped, the excess shared again.

    Sources in the order of cap over weight: the first ones that their share exceeds
    stop at their cap; the others divide the rest by weight.
    """
    by_name = Window.orderBy(F.col("_s") == "", "_s")
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                                                 ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most_epochs)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_s") == "", "_s").rowsBetween(
        Window.unboundedPreceding, -1)
    d = ranked.select("*", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).alias("_left"),
                      (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_wleft"))
    d = d.withColumn("_capped", F.col("_cap").cast("double") <= F.col("_w") * (F.col("_left").cast("double") / F.col("_wleft")))
    level = F.max(F.when(~F.col("_capped"), F.col("_left").cast("double") / F.col("_wleft"))).over(everything)
    return d.select("_s", "source_size", F.when(F.col("_capped"), F.col("_cap").cast("double"))
                    .otherwise(F.col("_w") * level).alias("target"))


def taken_words(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Rows with _s, _key, _words -> the same with source_size, target, taken.

    Reads the rows several times; hand over a written table.
    """
    rows = rows.withColumn("_bucket", F.shiftright(F.conv(F.substring("_key", 1, 4), 16, 10).cast("int"),
                                                   16 - (KEY_RANGES - 1).bit_length()))
    buckets = rows.groupBy("_s", "_bucket").agg(F.sum("_words").alias("_in_bucket"))
    sizes = buckets.groupBy("_s").agg(F.sum("_in_bucket").alias("source_size"))
    targets = source_targets(sizes, weights, most_epochs)
    earlier = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("_s", "_bucket", F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)).alias("_offset"))
    offsets = offsets.join(targets, "_s")
    inside = Window.partitionBy("_s", "_bucket").orderBy("_key", "_words").rowsBetween(Window.unboundedPreceding, -1)
    d = rows.join(offsets, ["_s", "_bucket"]).withColumn(
        "_before", F.col("_offset") + F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    d = d.withColumn("_epochs", whole).withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_rest") - F.col("_before")))
    return d.withColumn("taken", (F.col("_epochs") * F.col("_words") + part).cast("long")).drop(
        "_bucket", "_offset", "_before", "_epochs", "_rest")


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each document as often as its source needs it, with all its columns.

    A document that the budget cuts keeps its first words, joined by single spaces.
    """
    own, id_col, text_col, source_col = apart(docs, id_col, text_col, source_col)
    at = placed(own)
    rows = written(at.select("_file", "_row", *keyed(at, seed, id_col, text_col, source_col)), "sizes")
    taken = taken_words(rows, weights).where("taken > 0").select(
        "_file", "_row", F.col("_words").alias("_size"), F.col("taken").alias("_taken"))
    part = F.col("_taken") % F.col("_size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("_taken") / F.col("_size")).cast("int")),
                      F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    d = at.join(taken, ["_file", "_row"]).withColumn("_cut", F.explode(copies))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORDS})")), F.lit(1),
                                 F.col("_cut").cast("int")), " ")
    return d.withColumn(text_col, F.when(F.col("_cut") > 0, first).otherwise(F.col(text_col))).select(*own.columns).toDF(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = written(docs.select("doc_id", *keyed(docs, 0, "doc_id", "text", "source")), "sizes")
    return taken_words(rows).select("doc_id", F.col("_words").alias("size"), "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, 3 * source_size AS cap,
             sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER a, 0) AS rest,
             sum(w) OVER () - coalesce(sum(w) OVER a, 0) AS wrest
      FROM w WINDOW a AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap::DOUBLE <= w * (rest::DOUBLE / wrest) AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
             ELSE w * max(CASE WHEN NOT capped THEN rest::DOUBLE / wrest END) OVER () END AS target FROM c),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, floor(target + 0.5)::BIGINT AS budget,
             CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - bef)))::BIGINT AS taken
FROM e
"""
