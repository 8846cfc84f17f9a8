"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to length one and equal ones become one class.  A coarse quantiser
puts each class on one inverted list, with the residual as codes of its subspaces and the
length of what the codes miss.  Every class is also a query that probes the lists of its
nearest centroids; a table lookup per subspace estimates the distance, and since the true
distance is at most the missed length away from the estimate, entries within the
bound plus that length are kept and reranked by their exact cosine.  Lists are worked on in
blocks of bounded size, so a list that holds a third of all vectors is many tasks.  A
block returns link counts and a forest of links, never all pairs.

The quantisers are fitted on a bounded sample of classes (the first by hash: ``TRAIN_PER_LIST``
for each of at most ``MOST_LISTS`` lists); every vector is indexed and is a query.

Vectors of different lengths have no cosine: each length is indexed by itself.

Defined results: vectors that are null, zero or hold null or non-finite components
link with nothing; repeated ids and equal vectors link;
a null id never names a component that holds another id; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.components import roots
from parapet.llm.texts import table
from parapet.storage import remove, written

LEAST_COSINE = 0.9
TRAIN_PER_LIST, MOST_LISTS = 24, 16_384
PROBES, SUBSPACES, CODES = 8, 16, 64
#: entries and queries of a list that meet in one block
ENTRIES, QUERIES = 256, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest centroids of each row, the nearest first."""
    out = np.empty((len(x), k), dtype=np.int32)
    square = (c * c).sum(axis=1)
    for lo in range(0, len(x), 1024):
        d = square - 2 * (x[lo:lo + 1024] @ c.T)
        if k == 1:
            out[lo:lo + 1024, 0] = d.argmin(axis=1)
        else:
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
            out[lo:lo + 1024] = np.take_along_axis(near, order, 1)
    return out


def apart(c: np.ndarray, distance: float) -> np.ndarray:
    """The centroids without those that are nearer than ``distance`` to one that stays before them.

    Within that distance, neighbours would be strewn over more lists than a query probes.
    """
    stay = np.ones(len(c), dtype=bool)
    square = (c * c).sum(axis=1)
    for i in range(len(c)):
        if stay[i]:
            near = square[i + 1:] + square[i] - 2 * (c[i + 1:] @ c[i]) < distance ** 2
            stay[i + 1:] &= ~near
    return c[stay]


class Quantiser:
    """Coarse centroids and a code book per subspace, over residuals."""

    def __init__(self, sample: np.ndarray, lists: int, distance: float):
        x = sample.astype(np.float32)
        self.coarse = apart(kmeans(x, lists), distance)
        self.parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        rest = x - self.coarse[nearest(x, self.coarse, 1)[:, 0]]
        self.books = [kmeans(rest[:8192, p], CODES, seed=i + 1) for i, p in enumerate(self.parts)]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they miss."""
        rest = x - self.coarse[own]
        codes = np.empty((len(x), len(self.parts)), dtype=np.uint8)
        missed = np.zeros(len(x), dtype=np.float32)
        for m, p in enumerate(self.parts):
            codes[:, m] = nearest(rest[:, p], self.books[m], 1)[:, 0]
            missed += ((rest[:, p] - self.books[m][codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(missed)

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each entry's quantised vector, by table lookups."""
        rest = queries - self.coarse[at]
        out = np.zeros((len(queries), len(codes)), dtype=np.float32)
        for m, p in enumerate(self.parts):
            lookup = ((rest[:, None, p] - self.books[m][None]) ** 2).sum(axis=2)
            out += lookup[:, codes[:, m]]
        return out


def usable(v):
    """Whether a vector has a direction."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) &
                      F.exists(v, lambda x: x != 0), F.lit(False))


def forest(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node of its component) over the links of a boolean matrix."""
    a, b = rows.copy(), cols.copy()
    top = np.iinfo(np.int64).max
    while True:
        least_a = np.minimum(a, np.where(hit, b[None, :], top).min(axis=1, initial=top))
        least_b = np.minimum(b, np.where(hit, least_a[:, None], top).min(axis=0, initial=top))
        if (least_a == a).all() and (least_b == b).all():
            break
        a, b = least_a, least_b
    return [(int(n), int(r)) for n, r in zip(np.concatenate([rows, cols]), np.concatenate([a, b])) if n != r]


def vector_links(vectors: DataFrame, least: float = LEAST_COSINE, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """One row per row of the frame: the id, n_links, component_id and kept."""
    element = vectors.schema[vector_col].dataType.elementType
    # adding zero makes one of both zeros
    rows = vectors.select(F.col(id_col).alias("_id"), F.when(usable(F.col(vector_col)), F.transform(
        vector_col, lambda x: x + F.lit(0).cast(element))).alias("_v"))
    rows = rows.withColumn("_dim", F.size("_v")).withColumn("_h", F.xxhash64("_v"))
    # vectors of different lengths have no cosine: each length that two vectors share has an index of its own
    dims = [r["_dim"] for r in rows.where("_v IS NOT NULL").groupBy("_dim").count().where("count > 1").orderBy("_dim").collect()]
    alone = rows.where(~F.coalesce(F.col("_dim").isin(dims), F.lit(False)))
    out = alone.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"),
                       F.lit(True).alias("kept"))
    for dim in dims:
        out = out.unionByName(links_of_length(rows.where(F.col("_dim") == dim).drop("_dim"), least, id_col))
    return out


def links_of_length(rows: DataFrame, least: float, id_col: str) -> DataFrame:
    """The same for rows (_id, _v, _h) of usable vectors of one length."""
    spark = rows.sparkSession
    classes = rows.where("_v IS NOT NULL").groupBy("_v").agg(
        F.count(F.lit(1)).alias("_w"), F.min("_id").alias("_least"), F.first("_h").alias("_h"))
    classes = written(classes.withColumn("_c", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    lists = int(min(MOST_LISTS, max(1, 4 * n ** 0.5, 1)))
    lists = min(lists, n)
    sample = classes.orderBy("_h", "_c").limit(TRAIN_PER_LIST * lists).select("_v").toPandas()["_v"]
    sample = np.stack([np.asarray(v, dtype=np.float64) for v in sample])
    model = Quantiser(sample / np.linalg.norm(sample, axis=1, keepdims=True), lists, (2 - 2 * least) ** 0.5)
    lists = len(model.coarse)
    probes = min(PROBES, lists)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in b["_v"]])
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = nearest(x.astype(np.float32), model.coarse, probes)
            codes, missed = model.encode(x.astype(np.float32), near[:, 0])
            yield pd.DataFrame({"c": b["_c"], "w": b["_w"], "own": near[:, 0], "missed": missed,
                                "near": [r.tobytes() for r in near], "codes": [r.tobytes() for r in codes],
                                "x": [r.tobytes() for r in x]})

    coded = written(classes.mapInPandas(encode, "c long, w long, own int, missed float, near binary, codes binary, x binary"),
                    "coded")

    def count_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, held = np.zeros(lists, dtype=np.int64), np.zeros(lists, dtype=np.int64)
        for b in batches:
            asked += np.bincount(np.frombuffer(b"".join(b["near"]), dtype=np.int32), minlength=lists)
            held += np.bincount(b["own"], minlength=lists)
        yield pd.DataFrame({"at": np.arange(lists), "asked": asked, "held": held})

    # one row per list, of which there are MOST_LISTS at most
    sizes = coded.mapInPandas(count_probes, "at long, asked long, held long").groupBy("at").agg(
        F.sum("asked").alias("asked"), F.sum("held").alias("held")).toPandas().set_index("at")
    q_blocks, e_blocks = np.ones(lists, dtype=np.int64), np.ones(lists, dtype=np.int64)
    q_blocks[sizes.index] = np.maximum(1, -(-sizes["asked"] // QUERIES))
    e_blocks[sizes.index] = np.maximum(1, -(-sizes["held"] // ENTRIES))
    filled = np.zeros(lists, dtype=bool)
    filled[sizes.index] = sizes["held"] > 0

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each entry to its list's query blocks and each query to the entry blocks of the lists it probes."""
        for b in batches:
            near = np.frombuffer(b"".join(b["near"]), dtype=np.int32).reshape(len(b), -1)
            mixed = (b["c"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            for query in (False, True):
                for k in range(near.shape[1] if query else 1):
                    at = near[:, k].astype(np.int64)
                    times = np.where(filled[at], (e_blocks if query else q_blocks)[at], 0)
                    row = np.repeat(np.arange(len(b)), times)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    mine = (mixed[row] % (q_blocks if query else e_blocks)[at[row]].astype(np.uint64)).astype(np.int64)
                    part = b.iloc[row]
                    yield pd.DataFrame({"at": at[row], "qb": mine if query else other, "eb": other if query else mine,
                                        "query": query, **{c: part[c].to_numpy() for c in ("c", "w", "own", "missed", "near", "codes", "x")}})

    def block(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        q, e = d[d["query"]], d[~d["query"]]
        empty = pd.DataFrame({"a": [], "b": [], "n": []})
        if q.empty or e.empty:
            return empty
        at = int(key[0])
        qx = np.frombuffer(b"".join(q["x"]), dtype=np.float64).reshape(len(q), -1)
        ex = np.frombuffer(b"".join(e["x"]), dtype=np.float64).reshape(len(e), -1)
        codes = np.frombuffer(b"".join(e["codes"]), dtype=np.uint8).reshape(len(e), -1)
        bound = (2 - 2 * least) ** 0.5 + e["missed"].to_numpy(np.float32) + 1e-4
        near = model.distances(qx.astype(np.float32), at, codes) <= bound[None, :] ** 2
        qc, ec = q["c"].to_numpy(np.int64), e["c"].to_numpy(np.int64)
        near &= qc[:, None] != ec[None, :]
        if not near.any():
            return empty
        i, j = np.nonzero(near)
        good = np.zeros(len(i), dtype=bool)
        for lo in range(0, len(i), 1 << 15):
            s = slice(lo, lo + (1 << 15))
            good[s] = np.einsum("ij,ij->i", qx[i[s]], ex[j[s]]) >= least
        # a pair that both sides probe for is counted where the smaller number asks
        asks = np.frombuffer(b"".join(e["near"]), dtype=np.int32).reshape(len(e), -1)
        back = (asks[j] == q["own"].to_numpy(np.int32)[i][:, None]).any(axis=1)
        good &= ~back | (qc[i] < ec[j])
        if not good.any():
            return empty
        hit = np.zeros(near.shape, dtype=bool)
        hit[i[good], j[good]] = True
        n_q, n_e = hit @ e["w"].to_numpy(np.int64), hit.T @ q["w"].to_numpy(np.int64)
        some_q, some_e = n_q > 0, n_e > 0
        tree = forest(hit[np.ix_(some_q, some_e)], qc[some_q], ec[some_e])
        return pd.DataFrame({
            "a": np.concatenate([qc[some_q], ec[some_e], [t[0] for t in tree]]).astype(np.int64),
            "b": np.concatenate([np.full(some_q.sum() + some_e.sum(), -1), [t[1] for t in tree]]).astype(np.int64),
            "n": np.concatenate([n_q[some_q], n_e[some_e], np.zeros(len(tree))]).astype(np.int64)})

    dealt = coded.mapInPandas(deal, "at long, qb long, eb long, query boolean, c long, w long, own int, missed float, "
                                    "near binary, codes binary, x binary")
    found = written(dealt.groupBy("at", "qb", "eb").applyInPandas(block, "a long, b long, n long"), "vector-links")
    counts = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("n"))
    tops = roots(found.where("b >= 0"), "a", "b")
    member = classes.select("_c", "_v", "_h", "_w", "_least").join(counts, F.col("_c") == F.col("a"), "left").join(
        tops, F.col("_c") == F.col("node"), "left").select(
        "_v", "_h", "_least", (F.col("_w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "_c").alias("_root"))
    member = written(member, "vector-members")
    names = member.groupBy("_root").agg(F.min("_least").alias("component_id"))
    whole = written(member.join(names, "_root").select(F.col("_v").alias("_u"), F.col("_h").alias("_g"), "n_links", "component_id"),
                    "vector-components")
    remove(spark, coded, found, tops, member, classes)
    out = rows.join(whole, (F.col("_h") == F.col("_g")) & (F.col("_v") == F.col("_u")), "left")
    component = F.when(F.col("_u").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("_id").eqNullSafe(component), F.lit(False)).alias("kept"))


def op7_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return vector_links(table(spark, sf_dir, "embeddings"))
