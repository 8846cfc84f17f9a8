"""URL filter, embeddings and the pipeline against brute force."""

import collections

import numpy as np
from pyspark.sql import functions as F

from parapet.llm import preference, queries, url_filter, vector_dedup

URLS = [None, "", "no scheme", "http://", "http:///es/", "HTTP://A.Example.ORG/es/x?y#z", "x://example.org", "http://example.org/en/1",
        "http://myexample.org/en/12", "http://sub.example.org/en/2", "http://org/", "http://.org/", "http://a.com/fr/de/",
        "http://com/de/?q=/fr/", "http://a.com.net/de/", "http://b.com#/de/", "ftp://a.org/x://b.com/de/", "http://É.Com/de/\n/x",
        "http://a.com/fr/", "http://a.com/fr/"]


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    data = [*enumerate(URLS), (None, URLS[5])]
    pages = spark.createDataFrame(data, "page_id long, url string").withColumn("keys", F.lit(1)).withColumn("host", F.lit(2))
    got = collections.Counter(map(tuple, url_filter.judge(pages, url_filter.RULES).collect()))
    assert got == collections.Counter((i, *verdict(u)) for i, u in data)
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0


def test_cascade_is_exact_over_the_universe(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = keys.select("key", *url_filter.hashes(F.col("key"))).cache()
    listed = universe.where("pmod(hash(key), 5) = 0")
    found = url_filter.cascade(universe, listed, 6000)
    assert len(found.levels) > 3
    rows, inside = universe.toPandas(), {r["key"] for r in listed.collect()}
    assert (found.holds(rows["h1"].to_numpy(), rows["h2"].to_numpy()) == rows["key"].isin(inside).to_numpy()).all()


def test_vector_links(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "ENTRIES", 16)
    monkeypatch.setattr(vector_dedup, "QUERIES", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    data = [(i, (centres[i % 40] + 0.15 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(400)]
    data += [(400 + i, (centres[0] + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(150)]
    data += [(600, data[0][1]), (601, data[0][1]), (601, data[0][1]), (602, [2 * x for x in data[0][1]]), (603, None),
             (604, [0.0] * 16), (605, [1.0, None] + [0.0] * 14), (606, [float("nan")] * 16), (607, [float("inf")] + [1.0] * 15),
             (608, [1.0, 2.0]), (609, [-0.0] + [1.0] * 15), (610, [0.0] + [1.0] * 15), (None, data[5][1])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("_c", F.lit(1))
    got = vector_dedup.vector_links(frame).collect()
    ok = [i for i, (_, v) in enumerate(data) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([data[i][1] for i in ok], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    label = np.arange(len(ok))
    for _ in range(50):
        label = np.where(near, label[None, :], 10 ** 6).min(axis=1)
    expected, links = collections.Counter(), 0
    for k, i in enumerate(ok):
        ids = [data[ok[m]][0] for m in np.flatnonzero(label == label[k]) if data[ok[m]][0] is not None]
        expected[data[i][0], int(near[k].sum()) - 1, min(ids)] += 1
        links += int(near[k].sum()) - 1
    for i in set(range(len(data))) - set(ok):
        expected[data[i][0], 0, data[i][0]] += 1
    mine = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert sum(r["n_links"] for r in got) >= 0.9 * links and sum(r["n_links"] for r in got) <= links
    assert sum((mine & expected).values()) >= 0.9 * len(data)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert vector_dedup.vector_links(frame.limit(0)).count() == 0
    assert vector_dedup.vector_links(frame.where("vec_id = 603")).collect()[0]["n_links"] == 0


def test_each_length_of_vectors_is_linked_by_itself(spark):
    rng = np.random.default_rng(8)
    data = [(i, rng.standard_normal(12).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.1 * i, 0.0]) for i in range(4)]
    data += [(200, [2.0]), (201, [5.0]), (202, [-1.0]), (300, [1.0, 1.0]), (400, data[0][1]), (401, [0.5, 0.05, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.vector_links(
        spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    for i, v in data:
        unit = [(k, np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) for k, w in data if len(w) == len(v) and k != i]
        assert got[i][0] == sum(c >= 0.9 for _, c in unit), i
    assert got[200] == (1, 200, True) and got[201] == (1, 200, False) and got[202] == (0, 202, True) and got[300] == (0, 300, True)
    assert got[400][1] == 0 and got[401][1] == 100


def test_hashes_of_a_key_are_independent(spark):
    """The second hash must not follow from the first: with one seed after the other it would."""
    d = spark.range(2000).select(F.col("id").cast("string").alias("key")).select("key", *url_filter.hashes(F.col("key")))
    follows = d.where(F.col("h2") == F.xxhash64(F.col("key"), F.lit(1))).count()
    assert follows == 0 and d.select("h1").distinct().count() == d.select("h2").distinct().count() == 2000


def test_stages_keep_columns_named_like_their_helpers(spark):
    """Extra columns called like anything the stages use inside come out as they went in."""
    from parapet.llm import exact_dedup, mixing, quality, simhash

    extra = ["_file", "_row", "_cut", "_score", "_taken", "_size", "_id", "fp", "_keep", "_norm", "c0"]
    texts = ["one two three four five six seven eight", "one two three four five six seven eight ", "nine ten", "", None, "a b c d e f g h i j"]
    rows = [(i, t, "s", *(f"{n}{i}" for n in extra)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` string" for n in extra)]))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for stage in (exact_dedup.drop_copies, simhash.drop_near_copies, mixing.mix, lambda x: quality.keep_good(x, labels)):
        out = stage(d)
        assert out.columns == d.columns
        got = out.collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in extra)
        assert stage(d.limit(0)).collect() == []


def test_forest_spans_what_is_linked():
    hit = np.zeros((3, 4), dtype=bool)
    hit[0, 1] = hit[0, 3] = hit[2, 3] = True
    tree = dict(vector_dedup.forest(hit, np.array([10, 11, 12]), np.array([1, 2, 3, 4])))
    assert tree == {10: 2, 12: 2, 4: 2}


def test_pipeline_keeps_its_rules(spark):
    import corpus_pipeline
    from parapet.llm.texts import table, word_count

    sf = "/root/testdata/sf0.001"
    start = table(spark, sf, "documents")
    at, seen = start, []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf).cache()
        seen.append(at)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == start.columns
    good, exact, near, mixed, packed = seen
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    known = [i for i in labels if labels[i] == 1]
    assert sum(i in kept for i in known) >= 0.95 * len(known)
    assert exact.count() == good.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).distinct().count()
    assert 0 < near.count() <= exact.count()
    size = lambda d: d.agg(F.sum(word_count(F.col("text")))).first()[0]
    sources = near.select("source").distinct().count()
    assert abs(size(mixed) - size(near)) <= sources
    assert packed.agg(F.sum("length")).first()[0] > 0
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in mixed.select("doc_id").collect()}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_preferences(spark):
    turn = "array<struct<role:string,text:string>>"
    u, a, b = ("user", "hi <|end|>"), ("assistant", "yes"), ("assistant", "no")
    data = [(1, [u, a], [u, b]), (2, [u, a, u, a], [u, a]), (3, [u], [u]), (4, None, [u]), (5, [], None),
            (6, [(None, None), a, u, b], [("", ""), b]), (None, [a], [b])]
    frame = spark.createDataFrame(data, f"pair_id long, chosen {turn}, rejected {turn}").withColumn("prompt", F.lit("old"))

    def show(turns):
        return "".join(f"<|{r or ''}|>\n{(t or '').replace('<|', '< |')}<|end|>\n" for r, t in turns)

    for r in preference.format_preferences(frame).collect():
        sides = next(([[(x or "", y or "") for x, y in s or []] for s in d[1:]] for d in data if d[0] == r["pair_id"]))
        n = 0
        while n < min(map(len, sides)) and sides[0][n] == sides[1][n]:
            n += 1
        assert r["n_prefix"] == n and r["prompt"] == show(sides[0][:n])
        for name, side in zip(("chosen", "rejected"), sides):
            assert r[name] == show(side[n:])
            whole = r["prompt"] + r[name]
            cut = [whole[int(x.split("-")[0]):int(x.split("-")[1])] for x in r[f"{name}_spans"].split(",") if x]
            assert cut == [t.replace("<|", "< |") + "<|end|>\n" for role, t in side[n:] if role == "assistant"]
    convs = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "r"), (None, 0, "user", "x"),
                                   (3, None, None, None), (3, 1, "assistant", "z"), (3, 1, "assistant", "z")],
                                  "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_prefix"], r["rejected"]) for r in preference.format_preferences(preference.reply_pairs(convs)).collect()}
    none = "<|assistant|>\n<|end|>\n"
    assert got == {0: (1, none), 1: (1, ""), None: (1, ""), 3: (2, none)}
    assert preference.reply_pairs(convs.limit(0)).count() == 0
