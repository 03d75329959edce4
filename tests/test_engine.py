"""Reranking, tokenizers, chunking, store, cache, graph, batching, limiters, streams and sources."""

import dataclasses
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import errors, models
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.functions.vectors import Metric
from lodestone.operators import batching, cache, chunking, graph, measures, rerank, search, store, tokenizers
from lodestone.plans import config
from lodestone.plans.config import IndexConfig, ProjectionConfig
from lodestone.sources import files
from lodestone.streaming import flow, limiters

# Reranking


def candidates(spark, rows):
    return spark.createDataFrame([(0, i + 1, k, d, s, v) for i, (k, d, s, v) in enumerate(rows)], rerank.SCHEMA)


def test_mmr_against_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(25, 6))
    sims = np.sort(r.random(25))[::-1]
    rows = candidates(spark, [(i, float(1 - s), float(s), [float(t) for t in v]) for i, (s, v) in enumerate(zip(sims, x, strict=True))])
    q = spark.createDataFrame([(0, [1.0] * 6)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for lam in (0.0, 0.3, 0.5, 1.0):
        chosen = []
        while len(chosen) < 8:
            score = [-9.0 if i in chosen else lam * sims[i] - (1 - lam) * max([0.0, *(float(unit[i] @ unit[j]) for j in chosen)]) for i in range(25)]
            chosen.append(int(np.argmax(score)))
        got = [x_.id for x_ in rerank.rerank(rows, q, 8, rerank.diversity(lam)).orderBy("rank").collect()]
        assert got == chosen, lam


def test_rerank_rules(spark):
    rows = candidates(spark, [(1, 0.5, 0.9, [1.0, 0.0]), (2, 0.6, 0.5, None), (3, 0.7, 0.4, [0.0, 1.0])])
    q = spark.createDataFrame([(0, [0.0, 1.0])], "vec_id long, embedding array<double>")
    ids = lambda s, k: [r.id for r in rerank.rerank(rows, q, k, s).orderBy("rank").collect()]
    assert ids(rerank.exact(), 3) == [3, 2, 1]
    assert ids(rerank.threshold(0.5), 3) == [1, 2] and ids(rerank.none(), 2) == [1, 2] and ids(rerank.none(), 0) == []
    assert ids(rerank.composite(), 1) == [1, 2, 3] and ids(rerank.composite(rerank.threshold(0.45), rerank.exact()), 1) == [2]


# Tokenizers

VOCAB = {t: i for i, t in enumerate("[PAD] [CLS] [SEP] [UNK] [MASK] hello world embed ##ding".split())}
SPECIAL = {"pad": "[PAD]", "cls": "[CLS]", "sep": "[SEP]", "unk": "[UNK]", "mask": "[MASK]"}


def encoded(spark, tokenizer, texts, options=tokenizers.Options()):
    """ids, tokens and mask of each text."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.tokens, r["mask"]) for r in tokenizers.encode(df, tokenizer, options).collect()}
    return [got[i] for i in range(len(texts))]


def test_wordpiece_golden(spark):
    t = tokenizers.WordPiece(VOCAB, SPECIAL)
    whole, nothing = encoded(spark, t, ["Hello world embedding", None])
    assert whole == ([1, 5, 6, 7, 8, 2], "[CLS] hello world embed ##ding [SEP]".split(), [1] * 6) and nothing == ([1, 2], ["[CLS]", "[SEP]"], [1, 1])
    assert encoded(spark, t, ["Hello world embedding"], tokenizers.Options(5))[0][0] == [1, 5, 6, 7, 8]
    assert encoded(spark, t, ["hello"], tokenizers.Options(5, padding="max"))[0] == ([1, 5, 2, 0, 0], ["[CLS]", "hello", "[SEP]", "[PAD]", "[PAD]"], [1, 1, 1, 0, 0])
    assert encoded(spark, t, ["hello xyz " + "h" * 201], tokenizers.Options(special_tokens=False))[0][0] == [5, 3, 3]
    assert t.decode([1, 5, 7, 8, 3, 2, 0]) == "hello embedding [UNK]"
    assert encoded(spark, t, ["a b c d e f"], tokenizers.Options(4, "middle"))[0][1] == ["[CLS]", "[UNK]", "[UNK]", "[SEP]"]
    assert encoded(spark, t, ["a b hello"], tokenizers.Options(2, "start"))[0][1] == ["hello", "[SEP]"]
    with pytest.raises(Exception, match="longer than 2"):
        encoded(spark, t, ["hello world"], tokenizers.Options(2, "none"))
    with pytest.raises(errors.InvalidConfiguration):
        encoded(spark, tokenizers.WordPiece(VOCAB, {}), ["hello"], tokenizers.Options(5, padding="max"))


def test_frequent_words_and_repeated_ids(spark):
    """A word that most texts hold, rows of one id, and extra columns of the names used inside."""
    t = tokenizers.WordPiece(VOCAB, SPECIAL)
    df = spark.range(3000).select((F.col("id") % 2).alias("doc_id"), F.when(F.col("id") % 3 > 0, "hello world hello").otherwise("").alias("text"), F.lit("x").alias("word"), F.lit(1).alias("row"))
    got = tokenizers.encode(df, t, tokenizers.Options(special_tokens=False)).groupBy("doc_id", "ids").count().collect()
    assert sorted((r.doc_id, r.ids, r["count"]) for r in got) == [(0, [], 500), (0, [5, 6, 5], 1000), (1, [], 500), (1, [5, 6, 5], 1000)]
    assert tokenizers.encode(df.limit(0), t).count() == 0


def test_byte_bpe_round_trip_and_rank_order(spark):
    letters = list(tokenizers.byte_letters().values())
    assert len(set(letters)) == 256
    pairs = [("l", "o"), ("lo", "w"), ("e", "r"), ("Ġ", "low"), ("n", "e"), ("a", "a")]
    vocab = {t: i for i, t in enumerate([*letters, *("".join(p) for p in pairs)])}
    t = tokenizers.ByteBPE(vocab, {}, ranks={p: i for i, p in enumerate(pairs)})
    o = tokenizers.Options(0, special_tokens=False)
    t = dataclasses.replace(t, lowercase=False)
    r = random.Random(1)
    texts = ["low lower", "aaa", "it's 12345 ok", "héllo 👋\n\n x", "", *("".join(r.choices("lower naé \n1'", k=30)) for _ in range(50))]
    got = encoded(spark, t, texts, o)
    assert got[0][1] == ["low", "Ġlow", "er"] and got[1][1] == ["aa", "a"]
    assert [t.decode(ids) for ids, _, _ in got] == texts

    def slow(parts):
        while True:
            best = min((i for i in range(len(parts) - 1) if (parts[i], parts[i + 1]) in t.ranks), key=lambda i: (t.ranks[parts[i], parts[i + 1]], i), default=None)
            if best is None:
                return parts
            parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2 :]]

    for _ in range(200):
        w = r.choices("lowerna", k=r.randint(1, 15))
        assert t.merge(list(w)) == slow(list(w))


def test_other_tokenizers(spark):
    sp = tokenizers.SentencePiece({"▁hello": 0, "▁wor": 1, "ld": 2, "▁": 3, "[UNK]": 4, "x": 5}, {"unk": "[UNK]"})
    parts = encoded(spark, sp, ["Hello world xq"], tokenizers.Options(special_tokens=False))[0][1]
    assert parts == ["▁hello", "▁wor", "ld", "▁", "x", "[UNK]"] and sp.decode([0, 1, 2]) == "hello world"
    g = tokenizers.GreedyBPE({"ab": 0, "abc": 1, "c": 2, "bc": 3}, {}, merges={("a", "b"): "ab", ("ab", "c"): "abc", ("b", "c"): "bc"})
    assert encoded(spark, g, ["abc bc"], tokenizers.Options(special_tokens=False))[0][1] == ["abc", "bc"]
    df = spark.createDataFrame([(1, "Hello (world), it's!"), (2, None)], "doc_id long, text string")
    r = df.select(T.simple_tokens("text", True).alias("s"), T.basic_tokens("text").alias("b"), T.djb2_id(F.lit("hello")).alias("i")).first()
    assert r.s == ["[CLS]", "Hello", "(", "world", ")", ",", "it", "'", "s", "!", "[SEP]"] and r.b == ["hello", "(", "world", ")", ",", "it", "'", "s", "!"]
    h = 5381
    for b in b"hello":
        h = (h * 33 + b) % 2**64
    assert r.i == h % 100_000
    got = tokenizers.encode(df, sp, tokenizers.Options(special_tokens=False))
    assert tokenizers.decode(got, sp).where("doc_id = 2").first().text == ""


def test_tokenizer_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a\n\nb\na\n")
    assert files.vocabulary(spark, str(tmp_path / "v.txt")) == {"a": 2, "b": 1}
    (tmp_path / "s.vocab").write_text("# c\n▁a -1.0\n\nb -2.0\n")
    assert files.piece_vocabulary(spark, str(tmp_path / "s.vocab")) == {"▁a": 0, "b": 1}
    (tmp_path / "m.txt").write_text("#version\na b\nab c\n")
    assert files.merges(spark, str(tmp_path / "m.txt")) == {("a", "b"): 0, ("ab", "c"): 1}
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "added_tokens": [{"id": 3, "content": "</s>"}], "normalizer": {"type": "NFC"}}))
    t = files.tokenizer_file(spark, str(tmp_path / "t.json"))
    assert encoded(spark, t, ["ab"])[0][1] == ["ab", "</s>"] and t.normalization == "nfc"


# Chunking


def test_characters_against_the_rule(spark):
    assert chunking.by_characters("", 10, 2, 1) == [] and chunking.by_characters("abc", 0, 0, 0) == []
    text = "Hello world. " * 10
    c = chunking.by_characters(text, 50, 10, 10)
    assert len(c) >= 2 and all(len(x) >= 10 for x in c) and c[0] == text[:48].rstrip("o") or c[0].endswith(" ")
    got = chunking.chunk(spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string"), chunking.Chunking("characters", 50, 10, 10)).collect()
    assert {r.doc_id for r in got} == {1, 3}
    for r in got:
        if r.doc_id == 1:
            assert text[r.start : r.end] == r.text and r.total == len(c)


def test_sentences_and_paragraphs(spark):
    d = spark.createDataFrame([(1, "One. Two! Three? Four. Five"), (2, ""), (3, "no end"), (4, "A\n\nB\n\n\n\nC long paragraph here")], "doc_id long, text string")
    s = {r.doc_id: r.c for r in d.select("doc_id", T.chunk_sentences("text", 2, 50, 3).alias("c")).collect()}
    assert s[1] == ["One. Two!", "Two! Three?", "Three? Four.", "Four. Five", "Five"] and s[2] == [] and s[3] == ["no end"]
    p = {n: d.where("doc_id = 4").select(T.chunk_paragraphs("text", n, o, 3).alias("c")).first().c for n, o in ((1, 10), (2, 0))}
    assert p[1] == ["A", "A\n\nB", "B\n\nC long paragraph here", "C long paragraph here"]
    assert p[2] == ["A\n\nB", "C long paragraph here"]
    t = d.select("doc_id", T.simple_tokens("text").alias("tokens"))
    k = chunking.chunk_tokens(t, 4, 2).where("doc_id = 1").orderBy("index").collect()
    assert [x.n_tokens for x in k] == [4, 4, 4, 3] and k[0].text == "One.Two!" and k[1].start == 4


def test_aggregates(spark):
    c = spark.createDataFrame([(1, 0, [1.0, 0.0], 1), (1, 1, [0.0, 2.0], 3), (2, 0, [3.0, 4.0], 1)], "doc_id long, index int, vector array<float>, w int")
    get = lambda how, **k: {r.doc_id: r.vector for r in chunking.aggregate(c, how, normalize=False, **k).collect()}
    assert get("mean")[1] == [0.5, 1.0] and get("weighted", weight_col="w")[1] == [0.25, 1.5] and get("first")[1] == [1, 0] and get("last")[1] == [0, 2] and get("concatenate")[1] == [1, 0, 0, 2]
    assert chunking.aggregate(c, "mean").where("doc_id = 2").first().vector == pytest.approx([0.6, 0.8])
    assert {r.doc_id: r.vector for r in chunking.aggregate_custom(c, lambda v: v[-1]).collect()}[1] == [0, 2]
    ragged = c.unionByName(spark.createDataFrame([(1, 2, [9.0], 1)], c.schema))
    assert {r.doc_id: r.vector for r in chunking.aggregate(ragged, "mean", normalize=False, skip_mismatched=True).collect()}[1] == pytest.approx([1 / 3, 2 / 3])


# Models


def test_hash_embedder(spark):
    m = models.HashEmbedder(64)
    a, b, c = m.embed(["fruit salad", "apple salad", "truck engine"])
    assert np.linalg.norm(a) == pytest.approx(1) and a @ b > a @ c and (m.embed(["fruit salad"])[0] == a).all()
    d = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, None)], "doc_id long, text string")
    one, two = ({r.doc_id: r.vector for r in f(d, m).collect()} for f in (models.embed, models.embed_once))
    assert one == two and one[1] == one[2]
    with pytest.raises(Exception, match="empty"):
        models.embed(d, m, strict=True).collect()
    with pytest.raises(errors.ModelNotFound):
        models.Registry().load("none")
    assert models.output_shape([1, 4, 8], 4) == (4, 8) and models.output_shape([32], 4) == (4, 8) and models.output_shape([7], 4) == (1, 7)


# Store


def test_store_life(spark, tmp_path):
    s = store.VectorStore.create(spark, f"file://{tmp_path}/s", IndexConfig(3))
    rows = spark.createDataFrame([("a", [0.1, 0.2, 0.3], "hi", {"lang": "en"}), ("b", [0.9, 0.1, 0.0], "yo", None), (None, [0.0, 0.0, 1.0], None, None)], "id string, vector array<float>, text string, metadata map<string,string>")
    s.append(rows)
    assert s.rows().count() == 3 and s.rows().where("length(id) > 10").count() == 1
    s.append(spark.createDataFrame([("a", [1.0, 0.0, 0.0])], "id string, vector array<float>"))
    assert s.rows().where("id = 'a'").first().text is None and s.rows().count() == 3
    s.delete(spark.createDataFrame([("b",), ("zz",)], "id string"))
    before = sorted(r.id for r in s.rows().collect())
    s.checkpoint()
    t = store.VectorStore.load(spark, f"file://{tmp_path}/s")
    assert sorted(r.id for r in t.rows().collect()) == before and t.statistics().first()["count"] == 2
    t.append(rows.where("id = 'a'"))
    hit = t.search([0.1, 0.2, 0.3], 5, where=F.expr("metadata['lang'] = 'en'")).collect()
    assert [h.id for h in hit] == ["a"] and hit[0].similarity == pytest.approx(1, abs=1e-3)
    assert t.search([0.1, 0.2, 0.3], 0).count() == 0
    with pytest.raises(errors.DimensionMismatch):
        t.search([1.0], 1)
    with pytest.raises(Exception, match="DimensionMismatch"):
        t.append(spark.createDataFrame([("q", [1.0])], "id string, vector array<float>"))
    t.export_json(f"file://{tmp_path}/j")
    u = store.VectorStore.create(spark, f"file://{tmp_path}/u", IndexConfig(3, store_text=False))
    u.import_json(f"file://{tmp_path}/j")
    assert u.rows().count() == t.rows().count() and u.rows().where("text is not null").count() == 0
    t.clear()
    assert t.rows().count() == 0
    with pytest.raises(errors.StoreError):
        store.VectorStore.load(spark, f"file://{tmp_path}/none")


def test_store_ivf(spark, tmp_path):
    s = store.VectorStore.create(spark, f"file://{tmp_path}/i", IndexConfig(4, "ivf", lists=8, probes=4))
    r = np.random.default_rng(0)
    s.append(spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(r.normal(size=(100, 4)))], "id string, vector array<float>"))
    assert not s.is_trained
    s.train()
    assert s.is_trained and s.search([0.1, 0.0, 0.0, 0.2], 10).count() == 10


def test_configs():
    with pytest.raises(errors.InvalidConfiguration):
        IndexConfig(0)
    with pytest.raises(errors.InvalidConfiguration):
        IndexConfig(3, "ivf", lists=4, probes=5)
    with pytest.raises(errors.ProjectionError):
        ProjectionConfig(neighbours=1)
    c = IndexConfig.scalable(8, 10_000)
    assert (c.lists, c.probes) == (200, 12) and IndexConfig.from_dict(c.to_dict()) == c
    assert IndexConfig.from_dict({"dimension": 2, "kind": "odd", "metric": "odd"}).metric is Metric.COSINE
    assert config.FlowConfig.rate_limited(5).capacity == 10 and errors.DimensionMismatch.code == 2300 and errors.InferenceFailed.recoverable


# Cache


def test_cache(spark):
    now = lambda s: F.timestamp_seconds(F.lit(s))
    rows = spark.createDataFrame([("Hello  World", [1.0, 0.0]), ("other", [0.0, 1.0])], "text string, vector array<float>")
    c = cache.insert_absent(spark.createDataFrame([], cache.SCHEMA), cache.entries(rows, now(100), "m"))
    c = cache.insert_absent(c, cache.entries(rows, now(200), "m"))
    assert c.count() == 2 and c.agg(F.max("accessed_at").cast("long")).first()[0] == 100
    req = spark.createDataFrame([(1, " hello world"), (2, "new")], "id long, text string")
    hits = {r.id: r.hit for r in cache.lookup(c, req, "m").collect()}
    assert hits == {1: True, 2: False}
    vec = spark.createDataFrame([(1, [0.95, 0.05]), (2, [0.5, 0.5])], "id long, vector array<float>")
    assert [r.id for r in cache.lookup_semantic(c, vec, "m", 0.9).collect()] == [1]
    t = cache.touch(c, cache.lookup(c, req, "m").where("hit"), now(300))
    assert t.where("text = 'Hello  World'").first().access_count == 2
    assert [r.text for r in cache.evict_least_recent(t, 1).collect()] == ["Hello  World"] and cache.evict_expired(t, now(250)).count() == 1
    many = cache.entries(spark.createDataFrame([(f"text {i}", [0.0] * 10) for i in range(50)], "text string, vector array<float>"), now(5), "m").withColumn("accessed_at", F.timestamp_seconds(F.expr("cast(substring(text, 6) as long)")))
    left = cache.evict_over_size(many, 5000, block=5).agg(F.count("*"), F.min(F.expr("cast(substring(text, 6) as long)"))).first()
    assert tuple(left) == (20, 30)
    assert cache.evict_over_size(many, 10**9, max_count=50, block=5).count() == 45


# Graph


def test_graph_and_projection(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 0.1, (30, 5)), r.normal(3, 0.1, (30, 5))])
    d = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    y = np.array([p.position for p in graph.project(d, ProjectionConfig(neighbours=8, iterations=60)).orderBy("id").collect()])
    assert y.shape == (60, 2) and np.isfinite(y).all()
    spread = np.linalg.norm(y[:30] - y[:30].mean(0), axis=1).mean()
    assert np.linalg.norm(y[:30].mean(0) - y[30:].mean(0)) > spread
    with pytest.raises(errors.ProjectionError):
        graph.project(d.limit(5))
    a, b = graph.curve(ProjectionConfig())
    assert a == pytest.approx(1.577, abs=0.05) and b == pytest.approx(0.895, abs=0.05)
    e = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, weight double")
    lay = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "id long, position array<double>")
    g = {p.id: p.gradient for p in graph.gradient(e, lay).collect()}
    assert g[0][0] == -g[1][0] < 0 and g[0][1] == 0


# Batching and measures


def test_batching(spark):
    d = spark.createDataFrame([(i, n) for i, n in enumerate([1, 15, 16, 17, 40, 600, 600])], "doc_id long, n int")
    got = {r.doc_id: (r.bucket_key, r.batch, r.padding) for r in batching.micro_batches(d, F.col("n"), "doc_id", max_batch=2, shard=F.lit(0)).collect()}
    assert got[0] == (16, 0, 15) and got[2] == (16, 1, 0) and got[3] == (32, 0, 15) and got[5] == (512, 0, 0)
    alone = batching.micro_batches(d, F.col("n"), "doc_id", max_batch=8, padding_ratio=0.5, shard=F.lit(0)).where("bucket_key = 16").orderBy("doc_id").collect()
    assert [r.batch for r in alone] == [0, 1, 1]
    p = [0.0, 0.3, 0.31, 0.6, 0.8, 0.9, 1.0]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(batching.optimal_batch(F.col("p"))).collect()] == [128, 128, 64, 64, 32, 16, 16]
    f = lambda *a: spark.range(1).select(batching.should_flush(*map(F.lit, a))).first()[0]
    assert f(128, 0.0, 0.0, False, 0.1) and f(1, 0.2, 0.0, False, 0.1) and f(1, 0.0, 0.06, False, 0.1) and f(1, 0.0, 0.0, True, 0.1) and not f(1, 0.0, 0.0, False, 0.1) and not f(0, 9.0, 9.0, True, 0.9)
    assert batching.effective_batch_size(32, "critical") == 8 and batching.effective_batch_size(2, "critical", 1) == 1
    assert batching.progress(5, 10, 2.0) == {"fraction": 0.5, "items_per_second": 2.5, "eta": 2.0, "phase": "Processing"}
    assert spark.range(1).select(batching.latency_limit(F.lit("low"))).first()[0] == pytest.approx(0.3)


def test_measures(spark):
    d = spark.createDataFrame([("a", float(v)) for v in range(1, 101)], "m string, v double")
    got = {r.percentile: r.value for r in measures.percentiles(d, "v", ["m"]).collect()}
    assert got == {p: float(int(99 * p / 100) + 1) for p in measures.PERCENTILES}
    assert measures.approximate_percentiles(d, "v", ["m"]).count() == 6
    s = spark.createDataFrame([("processed", 1.0), ("dropped", None), ("processed", 3.0)], "o string, s double")
    r = measures.stream_statistics(s, "o", "s").first()
    assert (r.submitted, r.dropped, r.mean_seconds) == (3, 1, 2.0) and r.drop_rate == pytest.approx(1 / 3)
    assert [x[0] for x in spark.createDataFrame([(0.0005,), (0.25,), (2.0,)], "s double").select(T.duration(F.col("s"))).collect()] == ["500.0µs", "250.0ms", "2.0s"]


# Limiters and streams


def walked(limiter, events):
    out, states = [], {}
    for who, t in events:
        state = states.get(who) or limiter.start(t)
        states[who], ok = limiter.step(state, t, 1.0)
        out.append(ok)
    return out


@pytest.mark.parametrize("limiter", [limiters.TokenBucket(3, 0.5), limiters.FixedWindow(2, 5.0), limiters.LeakyBucket(2, 3.0), limiters.adaptive(2, 0.5)])
def test_limiters(spark, limiter):
    r = random.Random(3)
    t, events = 0.0, []
    for i in range(300):
        t += r.choice([0, 0.25, 1, 4])
        events.append((i, r.choice("abc"), t))
    d = spark.createDataFrame(events, "n long, who string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    got = [x.allowed for x in limiters.limit(d, limiter, "who", "ts", "n").orderBy("n").collect()]
    assert got == walked(limiter, [(w, x) for _, w, x in events])


def test_limiter_rules():
    b = limiters.TokenBucket(100, 0)
    assert sum(walked(b, [("x", 0.0)] * 150)) == 100
    w = limiters.FixedWindow(1, 10)
    assert walked(w, [("x", 0.0), ("x", 9.9), ("x", 10.0), ("x", 19.0)]) == [True, False, True, False]
    k = limiters.LeakyBucket(1, 2.0)
    assert walked(k, [("x", 0.0), ("x", 1.9), ("x", 2.5), ("x", 3.9), ("x", 4.0)]) == [True, False, True, False, True]


def test_streams(spark, tmp_path):
    src, limiter = f"{tmp_path}/in", limiters.TokenBucket(2, 0.0)
    schema = "n long, who string, ts timestamp"
    for part in range(2):
        spark.createDataFrame([(part * 10 + i, "ab"[i % 2]) for i in range(6)], "n long, who string").withColumn("ts", F.timestamp_seconds(F.col("n"))).coalesce(1).write.mode("append").parquet(src)
    s = limiters.limit_stream(flow.texts(spark, src, schema, 1), limiter, "who", "ts", "n")
    q = s.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.sql("select * from limited").collect()
    assert len(rows) == 12 and sum(r.allowed for r in rows) == 4
    seen = []
    texts = flow.texts(spark, src, schema).selectExpr("n as doc_id", "who as text")
    e = flow.embed_stream(texts, models.HashEmbedder(8), lambda df, epoch: seen.extend(df.collect()), f"{tmp_path}/d")
    e.awaitTermination(120)
    assert len(seen) == 12 and len(seen[0].vector) == 8
    assert flow.progress(e)


def test_documents_and_small_parts(spark):
    d = spark.createDataFrame([(i, f"word{i} " * 30) for i in range(20)], "doc_id long, text string")
    m = models.HashEmbedder(16)
    rows = chunking.embed_documents(d, chunking.Chunking("characters", 80, 10, 10), m)
    assert rows.count() > 20 and len(rows.first().vector) == 16
    one = chunking.embed_documents(d, chunking.Chunking("characters", 80, 10, 10), m, "weighted").collect()
    assert len(one) == 20 and np.linalg.norm(one[0].vector) == pytest.approx(1)
    assert graph.project_texts(d, m, ProjectionConfig(neighbours=5, iterations=5)).count() == 20
    e = models.embed(d, m)
    assert e.agg(V.all_normalized("vector")).first()[0] is True
    assert e.limit(0).agg(V.all_normalized("vector")).first()[0] is False
    assert spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "f array<float>").select(V.unflattened("f", 2)).first()[0] == [[1, 2], [3, 4]]
    dist = search.distances_from(e, [float(x) for x in e.where("doc_id = 3").first().vector], id_col="doc_id", vector_col="vector")
    assert dist.orderBy("distance").first().id == 3
    q = spark.createDataFrame([("high", True), ("low", False), ("high", False)], "p string, w boolean")
    assert {r.p: (r.requests, r.queued) for r in measures.queue_counts(q, "p", "w").collect()} == {"high": (2, 1), "low": (1, 0)}
    assert json.loads(measures.report_json(q).first().json) == {"p": "high", "w": True}


# Sources


def test_sources(spark, tmp_path):
    (tmp_path / "all-MiniLM-L6-v2.onnx").write_bytes(b"x" * 2000)
    (tmp_path / "small.onnx").write_bytes(b"x")
    (tmp_path / "bert-base-768.mlmodel").write_bytes(b"x" * 3000)
    found = files.models(spark, str(tmp_path)).collect()
    assert [(r.name, r.family, r.dimensions, r.is_embedding) for r in found] == [("all-MiniLM-L6-v2", "minilm", 384, True), ("bert-base-768", "bert", 768, False)]
    assert files.matching(files.models(spark, str(tmp_path)), "MINI").count() == 1
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, None)], "id long, t string, v array<float>")
    assert files.write_sqlite(df, str(tmp_path / "x.db"), "t") == 2
    assert {r.id: r.t for r in files.read_sqlite(spark, str(tmp_path / "x.db"), "select * from t").collect()} == {1: "a", 2: None}
    back = df.select("id", files.from_float_blobs(files.float_blobs("v")).alias("v")).orderBy("id").collect()
    assert back[0].v == [1.0, 2.0] and back[1].v is None
    raw = files.int8_blob(0.5, 0.0, -1.0, 1.0, [1, -2, 127])
    assert len(raw) == 19 and files.from_int8_blob(raw) == (0.5, 0.0, -1.0, 1.0, [1, -2, 127])
    assert not math.isnan(search.scalable_lists(1)[0])
