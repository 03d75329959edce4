"""Recall of the inverted file on all tables, the embedder, and cache maintenance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import models
from lodestone.functions import vectors as V
from lodestone.operators import cache, graph, search
from lodestone.plans import catalogue
from lodestone.plans.config import ProjectionConfig
from lodestone.sources import files


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_ivf_recall_on_tables(spark, sf):
    e = catalogue.vectors(spark, f"/root/testdata/{sf}")
    exact = search.knn(e, catalogue.asked(e), 10, "euclidean")
    assert search.recall(catalogue.probed(e), exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_ivf_blocks_do_not_change_hits(spark):
    e = catalogue.vectors(spark, "/root/testdata/sf0.001")
    c = catalogue.first_vectors(e, 4)
    got = [sorted(map(tuple, search.ivf_search(search.ivf_assign(e, c), catalogue.asked(e), c, 3, 5, block=b).drop("distance", "similarity").collect())) for b in (16_384, 7)]
    assert got[0] == got[1] and search.ivf_search(search.ivf_assign(e.limit(0), c), catalogue.asked(e), c, 3).count() == 0


def test_embedder_hears_shared_words_and_parts():
    m = models.HashEmbedder(256)
    a, b, c, d = m.embed(["the garden gate", "a garden wall", "gardening", "quick blue vehicle"])
    assert a @ b > 0.2 and a @ c > a @ d and abs(a @ d) < 0.3
    assert np.allclose([np.linalg.norm(v) for v in m.embed(["", "!?", "x", "word " * 10_000])], 1)


def test_quick_embed(spark):
    rows = models.quick_embed(spark, ["one", "two", "one"], dimension=16).collect()
    assert [r.text for r in rows] == ["one", "two", "one"] and rows[0].vector == rows[2].vector != rows[1].vector


def test_cache_warm_remove_clear(spark):
    m = models.HashEmbedder(8)
    texts = spark.createDataFrame([("a b",), ("A  b",), ("c",), (None,)], "text string")
    now = F.timestamp_seconds(F.lit(5))
    nothing = cache.entries(models.embed(texts.limit(0), m, "text").withColumn("text", F.col("text")), now, m.name)
    c = cache.warm(nothing, texts, m, now)
    assert c.count() == 2 and cache.warm(c, texts, m, now).count() == 2  # two texts share a hash
    assert [r.text for r in cache.remove(c, spark.createDataFrame([("C ",)], "text string"), m.name).collect()] == ["A  b"]
    assert cache.clear(c).count() == 0 and cache.clear(c, m.name).count() == 0 and cache.clear(c, "other").count() == 2


@pytest.mark.parametrize(("form", "n", "want"), [("float32", 5, 20), ("float16", 5, 10), ("int8", 5, 9), ("int4", 5, 7), ("binary", 9, 2)])
def test_stored_bytes(spark, form, n, want):
    assert spark.range(1).select(V.stored_bytes(F.lit(n), form)).first()[0] == want


def test_similar_texts_without_nulls(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], None), (3, [0.9, 0.2], "c"), (4, [-1.0, 0.0], "d")], "vec_id long, embedding array<double>, body string")
    found = search.find_similar(store, store.where("vec_id = 1"), 0.5, 3, text_col="body", metric="cosine")
    assert sorted((r.id, r.text) for r in found.collect()) == [(1, "a"), (3, "c")]


def test_model_folders(spark, tmp_path):
    inside = tmp_path / "bert-embed.mlpackage" / "Data"
    inside.mkdir(parents=True)
    (inside / "weights.bin").write_bytes(b"x" * 1500)
    (inside / "model.mlmodel").write_bytes(b"x" * 500)
    found = files.models(spark, str(tmp_path)).collect()
    assert [(r.name, r.type, r.size) for r in found] == [("bert-embed", "mlpackage", 2000)]


def test_sqlite_in_tasks(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), "id")).alias("t"), (F.col("id") / 4).alias("x"), F.array("id").alias("a"))
    folder = str(tmp_path / "out")
    assert files.write_sqlite(rows.repartition(3), folder, "docs") == 1000
    assert len(files.sqlite_files(folder)) == 3
    for key in (None, "id"):
        back = files.read_sqlite(spark, folder, "select * from docs", key, step=100)
        assert back.dtypes == [("id", "bigint"), ("t", "string"), ("x", "double"), ("a", "string")]
        assert sorted(map(tuple, back.collect())) == [(i, f"t{i}" if i % 7 else None, i / 4, f"[{i}]") for i in range(1000)] if key else back.count() == 1000
    assert files.read_sqlite(spark, folder, "select * from docs", "id", step=100).rdd.getNumPartitions() > 10
    assert files.read_sqlite(spark, folder, "select * from docs where id < 0", "id", "id long, t string, x double, a string").count() == 0


def test_sqlite_keys_that_are_no_integers(spark, tmp_path):
    path = str(tmp_path / "one.db")
    with files.closing(files.sqlite3.connect(path)) as con:
        con.execute("create table t (k, v)")
        con.executemany("insert into t values (?, ?)", [(1, 1), (None, 2.5), ("x", None), (250, 4)])
        con.commit()
    got = files.read_sqlite(spark, path, "select * from t", "k", step=100).collect()
    assert sorted((r.k or "", r.v or 0) for r in got) == [("", 2.5), ("1", 1), ("250", 4), ("x", 0)]


def test_numbers_of_nodes(spark):
    ids = [5, -3, 900, 17, 2**40]
    got = graph.numbered(spark.createDataFrame([(i,) for i in ids], "id long")).collect()
    assert {r.id: r.num for r in got} == {i: k for k, i in enumerate(sorted(ids))}


def test_layout_round_is_the_plain_loop(spark):
    config = ProjectionConfig(neighbours=2, iterations=10, negatives=2)
    r = np.random.default_rng(1)
    n, p = 9, r.uniform(-3, 3, (9, 2))
    edges = [(i, (i + k) % n) for i in range(n) for k in (1, 3)]
    a, b = graph.curve(config)
    want = np.zeros((n, 2))
    for s, t in edges:
        d = p[s] - p[t]
        g = np.clip(-2 * a * b * (d @ d) ** (b - 1) / (1 + a * (d @ d) ** b) * d, -4, 4)
        want[s], want[t] = want[s] + g, want[t] - g
    for k in np.random.default_rng([config.seed, 3]).integers(1, n, 2):
        for i in range(n):
            d = p[i] - p[(i + k) % n]
            want[i] += 2 * np.clip(2 * b / ((0.001 + d @ d) * (1 + a * (d @ d) ** b)) * d, -4, 4)
    want = p + 0.7 * np.clip(want, -10, 10)
    e = spark.createDataFrame([(s, t, 1.0) for s, t in edges], "s long, t long, w double")
    lay = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "num long, p0 double, p1 double")
    got = {x.num: (x.p0, x.p1) for x in graph.epoch_layout(e, lay, 3, n, config, (a, b)).collect()}
    assert np.allclose([got[i] for i in range(n)], want)
