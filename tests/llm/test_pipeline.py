"""The whole pipeline against plain Python, stage by stage and as a whole, on an awkward table."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from llm.data import SCHEMA, prose, rows
from llm.test_documents import count_words, norm, slow_fingerprint, targets
from parapet.llm import packing, quality
from parapet.llm.texts import table

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def first(group):
    return min(group, key=lambda r: (r[0] is None, r[0] or 0))


def good_rows(data, model):
    return [r for r in data if 1 / (1 + math.exp(-float(model.logits([(r[1] or "").encode()])[0]))) >= 0.3]


def without_copies(data):
    groups = collections.defaultdict(list)
    for r in data:
        groups[norm(r[1])].append(r)
    return [first(g) for g in groups.values()]


def without_near_copies(data):
    left, out = [(slow_fingerprint(r[1]), r) for r in data], []
    while left:
        group = [left.pop()]
        for f, _ in group:
            near = [x for x in left if (x[0] ^ f).bit_count() <= 4]
            left = [x for x in left if (x[0] ^ f).bit_count() > 4]
            group += near
        out.append(first([r for _, r in group]))
    return out


def mixed(data):
    sizes = collections.Counter({r[3]: 0 for r in data})
    for r in data:
        sizes[r[3]] += count_words(r[1])
    out = []
    for source, target in targets(sizes).items():
        own = sorted((hashlib.md5(f"0|{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest(), count_words(r[1]), r)
                     for r in data if r[3] == source) if sizes[source] else []
        budget = math.floor(target + 0.5)
        epochs, at = (budget // sizes[source] if sizes[source] else 0), 0
        for _, n, r in own:
            out += [r] * (epochs if n else 0)
            part = max(0, min(n, budget - epochs * sizes[source] - at))
            at += n
            if part == n and n:
                out.append(r)
            elif part:
                out.append((r[0], b" ".join(r[1].encode().split()[:part]).decode(), *r[2:]))
    return out


def pieces(data):
    vocabulary, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in data:
        ids = np.array([*vocabulary.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            out.append((r[0], k, at, len(part), zlib.crc32(part.tobytes())))
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with nulls, copies and columns named like helpers, and labels that tell two kinds of text apart."""
    rng, folder = random.Random(6), str(tmp_path_factory.mktemp("corpus"))
    data = [tuple(r) for r in rows()]
    data += [(1000 + i, prose(rng, 60, "abcde") if i % 2 else " | ".join(prose(rng, 1, "xyz#") for _ in range(60)), "en", rng.choice("ab"), 1, "k", "x", "y")
             for i in range(120)]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(1000 + i, i % 2) for i in range(110)] + [(1, None), (None, 1), (1002, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, data


def counted(frame):
    return collections.Counter(repr(tuple(r)) for r in frame.collect())


def expected(data):
    return collections.Counter(map(repr, data))


def test_each_stage_and_the_whole(spark, corpus):
    folder, data = corpus
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    want = data
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:4], (lambda d: good_rows(d, model), without_copies, without_near_copies, mixed)):
        before, want = want, plain(want)
        docs = stage(spark, spark.createDataFrame(before, SCHEMA), folder)
        assert docs.columns == COLUMNS and counted(docs) == expected(want), name
        assert len(want) < len(before) or name == "mixing sources"
    place = ("doc_id", "piece", "start", "length", "ids_crc32")
    for got in (corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(want, SCHEMA), folder), corpus_pipeline.run(spark, folder)):
        got = got.collect()
        assert collections.Counter(tuple(r[c] for c in place) for r in got) == collections.Counter(pieces(want))
        bins = collections.defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for members in bins.values():
            ends = [0]
            for offset, length in sorted(members):
                assert offset == ends[-1]
                ends.append(offset + length)
            assert ends[-1] <= packing.CAPACITY


def test_an_empty_table_goes_through(spark, corpus, tmp_path):
    folder, _ = corpus
    table(spark, folder, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, folder, "labels").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
