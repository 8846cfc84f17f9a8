"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become learned vectors plus one fixed channel, which tells whether the last four
bytes also stand a short way back.  Learned filters of 8 bytes run over them in steps
of 4; their rectified answers are averaged over chunks of 64 bytes that overlap by
half and cover the whole text; a second learned layer turns each chunk's averages into
features, the largest of each feature over all chunks is kept, and those maxima are
combined into one probability.  Long texts are worked on in overlapping segments with
the same chunks, so memory stays bounded and the result is that of the whole text.

Training uses a bounded sample: at most ``SAMPLE`` labelled rows of each label, in the order of a
hash of the id, with texts of at most ``SAMPLE_BYTES``; label counts come from all training rows.

Defined results: null and empty texts are scored as one chunk of padding; labels that
are null or contradict each other are not learned from; without rows of both labels
every score is the share of label 1 (0.5 without any); an empty table gives no rows;
repeated ids are scored row by row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.llm.texts import apart, table

SAMPLE, SAMPLE_BYTES = 1500, 32_768
STEP, HALF, CHUNK = 4, 32, 64
MARGIN = 36
LAGS = range(2, 25)
SEGMENT = 1 << 18
SLICE = 1 << 18
THRESHOLD = 0.3


def segments(data: bytes) -> list[tuple[int, int, int, int]]:
    """(first byte, last byte, chunks to skip, chunks to keep) of each segment of a text."""
    chunks = max(1, -(-max(len(data) - HALF, 0) // HALF))
    out = []
    for a in range(0, chunks, SEGMENT // HALF):
        n = min(SEGMENT // HALF, chunks - a)
        skip = 2 if a else 0
        out.append(((a - skip) * HALF, min(len(data), (a + n + 4) * HALF), skip, n))
    return out


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another as byte numbers (0: padding) with the chunks of each.

    Returns the numbers, the places of each part's last block, and for each part its first
    kept chunk, its number of kept chunks and the text it belongs to.
    """
    parts, starts, keeps, owner, ends, at = [], [], [], [], [], 0
    for t, data in enumerate(texts):
        for lo, hi, skip, n in segments(data):
            size = -(-max(hi - lo + MARGIN, CHUNK + HALF) // HALF) * HALF
            x = np.zeros(size, dtype=np.uint16)
            x[:hi - lo] = np.frombuffer(data, dtype=np.uint8, count=hi - lo, offset=lo)
            x[:hi - lo] += 1
            parts.append(x)
            starts.append(at // HALF + skip)
            keeps.append(n)
            owner.append(t)
            at += size
            ends.append(at // STEP - 1)
    return np.concatenate(parts), np.array(ends), np.array(starts), np.array(keeps), np.array(owner)


def echo(x: np.ndarray) -> np.ndarray:
    """1 where the four bytes that end here are also found a few bytes back."""
    gram = x.astype(np.uint32) & 255
    gram[1:] |= gram[:-1] << 8
    gram[2:] |= (gram[:-2] & 65535) << 16
    seen = np.zeros(len(x), dtype=bool)
    for lag in LAGS:
        seen[lag:] |= gram[lag:] == gram[:-lag]
    real = x > 0
    seen &= real
    for k in (1, 2, 3):
        seen[k:] &= real[:-k]
    seen[:3] = False
    return seen


@dataclass
class Network:
    """Weights of the network; see the module's text for what each layer does."""

    vectors: int = 8
    filters: int = 24
    features: int = 16
    seed: int = 1
    p: dict = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        wide = 2 * STEP * (self.vectors + 1)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "bytes": draw(257, self.vectors, scale=0.5), "conv": draw(wide, self.filters, scale=(2 / wide) ** 0.5),
            "conv0": np.zeros(self.filters, np.float32), "mid": draw(self.filters, self.features, scale=0.4),
            "mid0": np.zeros(self.features, np.float32), "out": draw(self.features, scale=0.3),
            "out0": np.zeros(1, np.float32)}
        self.p["bytes"][0] = 0

    def inputs(self, x: np.ndarray, heard: np.ndarray) -> np.ndarray:
        v = np.empty((len(x), self.vectors + 1), dtype=np.float32)
        v[:, :-1] = self.p["bytes"][x]
        v[:, -1] = heard
        return v.reshape(-1, STEP * (self.vectors + 1))

    def conv(self, blocks: np.ndarray, ends: np.ndarray) -> np.ndarray:
        k = self.p["conv"]
        half = len(k) // 2
        z = blocks @ k[:half]
        z[:-1] += blocks[1:] @ k[half:]
        z += self.p["conv0"]
        np.maximum(z, 0, out=z)
        z[ends] = 0
        return z

    def chunk_means(self, z: np.ndarray) -> np.ndarray:
        halves = z.reshape(-1, HALF // STEP, self.filters).mean(axis=1)
        halves[:-1] += halves[1:]
        return halves / 2

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Largest value of each feature of each text, and what training needs."""
        x, ends, starts, keeps, owner = laid_out(texts)
        heard = echo(x)
        means = self.chunk_means(self.conv(self.inputs(x, heard), ends))
        chunk = np.repeat(starts - np.concatenate([[0], np.cumsum(keeps)[:-1]]), keeps) + np.arange(keeps.sum())
        means = means[chunk]
        feats = means @ self.p["mid"] + self.p["mid0"]
        np.maximum(feats, 0, out=feats)
        first = np.concatenate([[0], np.cumsum(keeps)[:-1]])
        text_first = first[np.unique(owner, return_index=True)[1]]
        return np.maximum.reduceat(feats, text_first, axis=0), (x, heard, ends, chunk, means, feats, text_first)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < SLICE):
                size += len(texts[hi]) + CHUNK
                hi += 1
            best = self.long_text(texts[lo]) if hi == lo + 1 else self.pooled(texts[lo:hi])[0]
            out[lo:hi] = best @ self.p["out"] + self.p["out0"][0]
            lo = hi
        return out

    def long_text(self, data: bytes) -> np.ndarray:
        """Maxima of one text, segment by segment."""
        best = None
        for lo, hi, skip, n in segments(data):
            part = data[lo:hi]
            x = np.zeros(-(-max(len(part) + MARGIN, CHUNK + HALF) // HALF) * HALF, dtype=np.uint16)
            x[:len(part)] = np.frombuffer(part, dtype=np.uint8)
            x[:len(part)] += 1
            means = self.chunk_means(self.conv(self.inputs(x, echo(x)), np.array([len(x) // STEP - 1])))[skip:skip + n]
            top = np.maximum(means @ self.p["mid"] + self.p["mid0"], 0).max(axis=0)
            best = top if best is None else np.maximum(best, top)
        return best[None, :]

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict:
        best, (x, heard, ends, chunk, means, feats, text_first) = self.pooled(texts)
        z = best @ self.p["out"] + self.p["out0"][0]
        d = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        g = {"out": best.T @ d, "out0": np.array([d.sum()], np.float32)}
        # only the chunk that gave a maximum learns from it
        d_best = d[:, None] * self.p["out"] * (best > 0)
        bounds = np.append(text_first, len(feats))
        d_feats: dict[int, np.ndarray] = {}
        for t in range(len(texts)):
            at = feats[bounds[t]:bounds[t + 1]].argmax(axis=0) + bounds[t]
            for f, c in enumerate(at.tolist()):
                if d_best[t, f]:
                    d_feats.setdefault(c, np.zeros(self.features, np.float32))[f] += d_best[t, f]
        g |= {k: np.zeros_like(self.p[k]) for k in ("bytes", "conv", "conv0", "mid", "mid0")}
        if not d_feats:
            return g
        used = np.array(sorted(d_feats))
        df = np.stack([d_feats[c] for c in used])
        g["mid"], g["mid0"] = means[used].T @ df, df.sum(axis=0)
        d_means = df @ self.p["mid"].T / (CHUNK // STEP)
        # the blocks under each used chunk, one more for the last filter's second half
        width = CHUNK // STEP
        block = chunk[used][:, None] * (HALF // STEP) + np.arange(width + 1)
        block = np.minimum(block, len(x) // STEP - 1)
        at = block[:, :, None] * STEP + np.arange(STEP)
        v = np.concatenate([self.p["bytes"][x[at]], heard[at][..., None].astype(np.float32)], axis=-1)
        v = v.reshape(len(used), width + 1, -1)
        both = np.concatenate([v[:, :-1], v[:, 1:]], axis=-1)
        z = both @ self.p["conv"] + self.p["conv0"]
        dz = (z > 0) * d_means[:, None, :]
        dz[np.isin(block[:, :-1], ends)] = 0
        g["conv"] = np.tensordot(both, dz, axes=([0, 1], [0, 1]))
        g["conv0"] = dz.sum(axis=(0, 1))
        db = dz @ self.p["conv"].T
        half = db.shape[-1] // 2
        dv = np.zeros_like(v)
        dv[:, :-1] += db[..., :half]
        dv[:, 1:] += db[..., half:]
        dv = dv.reshape(len(used), width + 1, STEP, self.vectors + 1)[..., :-1]
        np.add.at(g["bytes"], x[at].reshape(-1), dv.reshape(-1, self.vectors))
        g["bytes"][0] = 0
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 14, batch: int = 24, rate: float = 0.006) -> None:
        rng = np.random.default_rng(self.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                pick = order[lo:lo + batch]
                g = self.gradients([texts[i] for i in pick], y[pick])
                t += 1
                now = rate * (1 - t / (total + 1))
                for k, v in g.items():
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.01 * (v * v - s[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.99 ** t)) + 1e-8)


def held_out(id_col: str, folds: int = 5):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Network | float:
    """A network, or one score for all where there is nothing to tell apart."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(
        id_col).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_max")).where("_y = _max").drop("_max")
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return 0.5 if not counts else float(next(iter(counts)))
    by_hash = (F.xxhash64(id_col), id_col)
    picked = known.where("_y = 0").orderBy(*by_hash).limit(SAMPLE).unionByName(
        known.where("_y = 1").orderBy(*by_hash).limit(SAMPLE))
    # at most two times SAMPLE ids
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).join(F.broadcast(picked), id_col).where(
        F.octet_length(text_col) <= SAMPLE_BYTES)
    # rows that repeat an id are cut in the plan, before anything comes to the driver
    rows = sorted(rows.orderBy(*by_hash, text_col).limit(4 * SAMPLE).collect(), key=lambda r: (r[id_col], r[text_col]))
    y = np.array([r["_y"] for r in rows], dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return counts[1] / (counts[0] + counts[1])
    net = Network()
    net.fit([(r[text_col] or "").encode() for r in rows], y)
    # the sample holds the labels in other shares than the table
    share = float(y.sum() / (len(y) - y.sum()))
    net.p["out0"] += np.float32(np.log(counts[1] / counts[0] / share))
    return net


def score(docs: DataFrame, model: Network | float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of the frame and the score of each whole text."""
    kept = [c for c in docs.columns if c != score_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score_col, T.DoubleType())])
    if not isinstance(model, Network):
        return docs.withColumn(score_col, F.lit(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch[text_col]]
            z = np.clip(model.logits(texts), -500, 500) if texts else np.zeros(0)
            yield batch[kept].assign(**{score_col: 1 / (1 + np.exp(-z))})

    return docs.mapInPandas(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier takes for good ones."""
    model = train(docs, labels)
    own, text = apart(docs, "text")
    return score(own, model, text, "_score").where(F.col("_score") >= THRESHOLD).select(*own.columns).toDF(*docs.columns)
