"""Source divergence audit with dominance skybands.

Terms are counted per (lang, source), added up inside a task first.  Each lang keeps the
terms of enough of its documents.  A term's smoothed share p in a group and q in its lang give the
value ``f = floor((p - q)^2 / (p + q))``, which grows with the group's count and shrinks with
the lang's.  So a term that k others dominate (no lower group count, no higher lang count,
earlier in UTF-8) has k terms ranked before it and cannot be among the first k.  Each partition
retains the k-skyband of each group, the terms with fewer than k such others; skybands of
several partitions are merged into one; what is left is ranked exactly.

Two sources are compared over all kept terms of their lang: tasks see a bucket of terms
and two blocks of sources, and terms that neither block holds are added in closed form, since
every such term has the same pair of shares.

Defined results: null text, lang and source count as empty strings; a group without terms
still takes part; a lang without kept terms gives pairs of value 0; repeated rows count again;
an empty table gives no rows; other columns are not read.  The pairs of a lang's
sources are as many as the square of their number: that is the report's own size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parapet.llm.texts import cuts, table
from parapet.storage import written

LEAST_DOCS, MOST_TERMS = 10, 10
SCALE, PRIOR = 1_000_000_000, 2
#: bytes that make up terms, A-Z lower-cased; all others become spaces
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: counted terms held by a task before they are sent on; bytes of a long text looked at together
HELD, PIECE = 400_000, 1 << 20
#: rows of a group that wait for the next look at its skyband, and rows compared at once
WAITING, COMPARED = 4096, 1024
#: partitions whose skybands are merged into one; ranking takes the merged ones
MERGED = 32
#: terms in a bucket and sources in a block of the pair sums
BUCKET, BLOCK = 4096, 128
OUT = ["lang", "source", "part", "item", "value", "rank"]


def named(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def occurrences(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term, n and docs, added up inside each task; a term may come in several rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple, Counter] = {}
        within: dict[tuple, Counter] = {}

        def rows() -> Iterator[pd.DataFrame]:
            every = ((*group, term.decode(), n, within[group][term]) for group, found in counts.items() for term, n in found.items())
            while some := list(islice(every, 100_000)):
                yield pd.DataFrame(some, columns=["lang", "source", "term", "n", "docs"])
            counts.clear()
            within.clear()

        held = 0
        for batch in batches:
            for text, lang, source in zip(*(batch.iloc[:, i] for i in range(3))):
                data, group, seen = text.encode().translate(TERM_BYTES), (lang, source), set()
                if group not in counts:
                    counts[group], within[group] = Counter(), Counter()
                    held += 10
                count = counts[group]
                held -= len(count)
                for lo, hi in cuts(data, PIECE, (b" ",)):
                    terms = data[lo:hi].split()
                    count.update(terms)
                    seen.update(terms)
                held += len(count)
                within[group].update(seen)
                if held > HELD:
                    yield from rows()
                    held = 0
        yield from rows()

    return docs.select(named(text_col).alias("text"), named(lang_col).alias("lang"), named(source_col).alias("source")).mapInPandas(
        run, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, least_docs: int, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, term, source, n and lang_n of every kept term in every group that holds it (written).

    Rows are dealt once, by lang and term; sums per source and per lang need no other shuffle.
    """
    dealt = occurrences(docs, text_col, lang_col, source_col).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a frame of at most as many rows as the lang has sources
    of_lang = Window.partitionBy("lang", "term")
    totals = by_source.select("lang", "term", "source", "n", F.sum("n").over(of_lang).alias("lang_n"), F.sum("docs").over(of_lang).alias("_docs"))
    return written(totals.where(F.col("_docs") >= least_docs).drop("_docs"), "terms")


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """Smoothed share in billionths; decimals keep the product exact at any size."""
    c, n, v = (x if isinstance(x, Column) else F.col(x) for x in (count, total, terms))
    up = (c + PRIOR).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    # a lang without kept terms has no shares, and no use for them
    return F.call_function("div", up, F.greatest(n + PRIOR * v, F.lit(1)).cast("decimal(19,0)")).cast("long") + 1


def gap(p: Column | str, q: Column | str) -> Column:
    p, q = (x if isinstance(x, Column) else F.col(x) for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def skyband(n: np.ndarray, lang_n: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that fewer than k others dominate; terms differ.

    In the order of count down, lang count up, term up every dominator comes first, and one that
    is itself dominated k times may be left out of the counting: its own dominators do.
    """
    place = np.empty(len(term), dtype=np.int64)
    place[sorted(range(len(term)), key=term.__getitem__)] = np.arange(len(term))
    order = np.lexsort([place, lang_n, -n])
    best = np.zeros(0, dtype=np.int64)
    for lo in range(0, len(order), COMPARED):
        new = order[lo:lo + COMPARED]
        earlier = np.zeros(len(new), dtype=np.int64)
        for at in range(0, len(best), COMPARED):
            old = best[at:at + COMPARED]
            earlier += ((lang_n[old] <= lang_n[new][:, None]) & (place[old] < place[new][:, None])).sum(axis=1)
        among = (lang_n[new] <= lang_n[new][:, None]) & (place[new] < place[new][:, None])
        earlier += np.tril(among, -1).sum(axis=1)
        best = np.concatenate([best, new[earlier < k]])
    return best


def retained(rows: DataFrame, k: int) -> DataFrame:
    """lang, source, term, n, lang_n of each partition's skybands, and ``part``, the partition's number."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[tuple, list[pd.DataFrame]] = {}
        waiting: Counter = Counter()

        def shrink(group: tuple) -> pd.DataFrame:
            all_rows = pd.concat(groups[group], ignore_index=True)
            keep = skyband(all_rows["n"].to_numpy(), all_rows["lang_n"].to_numpy(), all_rows["term"].to_numpy(object), k)
            groups[group], waiting[group] = [all_rows.iloc[keep]], 0
            return groups[group][0]

        for batch in batches:
            for group, own in batch.groupby(["lang", "source"], sort=False):
                groups.setdefault(group, []).append(own)
                waiting[group] += len(own)
                if waiting[group] > WAITING:
                    shrink(group)
        part = TaskContext.get().partitionId()
        for group in groups:
            yield shrink(group).assign(part=part)

    return rows.select("lang", "source", "term", "n", "lang_n").mapInPandas(
        run, "lang string, source string, term string, n long, lang_n long, part int")


def merged(bands: DataFrame, k: int) -> DataFrame:
    """Skybands of ``MERGED`` partitions at a time as one."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keep = skyband(rows["n"].to_numpy(), rows["lang_n"].to_numpy(), rows["term"].to_numpy(object), k)
        return rows.iloc[keep].drop(columns="part")

    return bands.withColumn("part", F.floor(F.col("part") / MERGED).cast("int")).groupBy("lang", "source", "part").applyInPandas(
        run, "lang string, source string, term string, n long, lang_n long")


def ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    at = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    rows = rows.withColumn("rank", F.row_number().over(at))
    return (rows if most is None else rows.where(F.col("rank") <= most)).select(*OUT)


def leading_terms(counts: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """The first k terms that each group uses more than its lang does.

    Dominators of a term with p > q have p > q too, so the band is taken over these terms alone.
    """
    both = counts.join(groups, ["lang", "source"]).where(share("n", "group_n", "terms") > share("lang_n", "lang_total", "terms"))
    band = merged(retained(both, k), k).join(groups, ["lang", "source"])
    value = gap(share("n", "group_n", "terms"), share("lang_n", "lang_total", "terms"))
    return ranked(band.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")), k)


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (a before b), the sum of f over terms seen together and how many those were."""
    p = share("n", "group_n", "terms").alias("p")
    sizes = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.count(F.lit(1)).alias("sources")).select(
        "lang", F.ceil(F.greatest(F.col("terms"), F.lit(1)) / BUCKET).cast("int").alias("buckets"),
        F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    # each row meets the rows of every block, its own included; the lower block's number comes first
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def dealt(d: DataFrame) -> DataFrame:
        d = d.withColumn("own", block).withColumn("other", other)
        return d.select("lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "bucket", "own",
                        "source", "term", "p")

    seen = counts.join(groups.select("lang", "source", "group_n", "terms"), ["lang", "source"]).select("lang", "source", "term", p).join(
        sizes, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    # a source's share of terms that it does not hold, once in every bucket
    base = groups.select("lang", "source", F.lit(None).cast("string").alias("term"),
                         share(F.lit(0).cast("long"), "group_n", "terms").alias("p")).join(sizes, "lang").withColumn(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, i, j = key[0], int(key[1]), int(key[2])
        is_base = rows["term"].isna().to_numpy()
        sources = rows[is_base]
        place = {s: x for x, s in enumerate(sources["source"])}
        term, _ = pd.factorize(rows["term"][~is_base])
        n_terms = int(term.max()) + 1 if len(term) else 0
        shares = np.repeat(sources["p"].to_numpy(np.int64)[:, None], n_terms, axis=1)
        shares[rows["source"][~is_base].map(place).to_numpy(np.int64), term] = rows["p"][~is_base].to_numpy(np.int64)
        names, own = list(place), sources["own"].to_numpy()
        out = []
        for x in range(len(names)):
            with_whom = np.flatnonzero(own == j) if own[x] == i else np.zeros(0, dtype=np.int64)
            if i == j:
                with_whom = with_whom[with_whom > x]
            d, s = shares[with_whom] - shares[x], shares[with_whom] + shares[x]
            for y, value in zip(with_whom.tolist(), (d * d // s).sum(axis=1).tolist()):
                a, b = sorted((names[x], names[y]))
                out.append((lang, a, b, value, n_terms))
        return pd.DataFrame(out, columns=["lang", "a", "b", "value", "seen"])

    parts = dealt(seen).unionByName(dealt(base)).groupBy("lang", "i", "j", "bucket").applyInPandas(
        run, "lang string, a string, b string, value long, seen long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))


def source_pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Every other source of each group's lang with the divergence of the two."""
    base = groups.select("lang", "source", "terms", share(F.lit(0).cast("long"), "group_n", "terms").alias("p"))
    d = pair_sums(counts, groups).join(base.withColumnRenamed("source", "a").withColumnRenamed("p", "pa"), ["lang", "a"]).join(
        base.drop("terms").withColumnRenamed("source", "b").withColumnRenamed("p", "qb"), ["lang", "b"])
    unseen = (F.col("terms") - F.col("seen")) * gap("pa", "qb")
    value = (F.col("value") + F.when(F.col("terms") > 0, unseen).otherwise(0)).alias("value")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    return ranked(d.select("lang", value, both).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS, text_col: str = "text",
               lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    counts = kept_counts(docs, least_docs, text_col, lang_col, source_col)
    of_lang = counts.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(
        F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    every = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source")).distinct()
    groups = written(every.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("group_n", "lang_total", "terms")]), "groups")
    return leading_terms(counts, groups, most_terms).unionByName(source_pairs(counts, groups))


def op12_skyband(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of ``documents``."""
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(
      coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
lt AS (SELECT lang, sum(n)::BIGINT AS n, count(*) AS v FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT t.lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(gt.n, 0) + 2 * lt.v))::BIGINT AS p,
    1 + (1000000000::HUGEINT * (kept.n + 2) // (lt.n + 2 * lt.v))::BIGINT AS q
  FROM g JOIN kept ON g.lang = kept.lang JOIN lt ON lt.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
