"""Vector expressions against hand-computed values and numpy."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.functions.vectors import Metric
from lodestone.operators import search


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'array<array<float>>' if v and isinstance(v[0], list) else 'array<float>'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first()[0]


def test_by_hand(spark):
    assert one(spark, V.norm("a"), a=[3.0, 4.0]) == 5
    assert one(spark, V.normalize("a"), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalize("a"), a=[0.0, 0.0]) == [0, 0]
    a, b = [1.0, 2.0, 3.0], [4.0, 6.0, 3.0]
    got = {m: one(spark, V.distance("a", "b", m), a=a, b=b) for m in Metric}
    assert got[Metric.EUCLIDEAN] == 5 and got[Metric.MANHATTAN] == 7 and got[Metric.CHEBYSHEV] == 4 and got[Metric.DOT] == -25
    assert got[Metric.COSINE] == pytest.approx(1 - 25 / math.sqrt(14 * 61))
    assert one(spark, V.add("a", "b"), a=a, b=b) == [5, 8, 6]
    assert one(spark, V.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 0.0]) == 0
    assert one(spark, V.dot("a", "a"), a=[]) == 0 and one(spark, V.chebyshev("a", "a"), a=[]) == 0 and one(spark, V.mean("a"), a=[]) == 0
    assert one(spark, V.checked("a", "b", V.cosine("a", "b"), F.lit(0.0)), a=[1.0], b=[1.0, 2.0]) == 0


def test_similarity_of_distance(spark):
    row = spark.range(1).select(V.similarity(F.lit(0.25), Metric.COSINE), V.similarity(F.lit(4.0), Metric.EUCLIDEAN), V.similarity(F.lit(-0.5), Metric.DOT), V.similarity(F.lit(2.0), Metric.MANHATTAN), V.similarity(F.lit(1.5), None)).first()
    assert list(row) == pytest.approx([0.75, math.exp(-2), 0.75, math.exp(-2), 0])


def test_statistics_and_validity(spark):
    s = one(spark, V.statistics("a"), a=[1.0, 2.0, 3.0, 4.0])
    assert (s["count"], s["min"], s["max"], s["mean"], s["range"]) == (4, 1, 4, 2.5, 3) and s["stddev"] == pytest.approx(math.sqrt(1.25))
    assert one(spark, V.statistics("a"), a=[])["mean"] == 0
    v = one(spark, V.validity("a"), a=[1.0, float("nan"), float("inf"), float("-inf"), float("inf")])
    assert (v["nan"], v["pos_inf"], v["neg_inf"], v["valid"]) == (1, 2, 1, False)
    assert one(spark, V.is_normalized("a"), a=[0.6, 0.8]) and not one(spark, V.is_normalized("a"), a=[])


def test_pooling(spark):
    t = [[1.0, 2.0], [3.0, 4.0], [5.0, 0.0]]
    m = F.array(F.lit(1), F.lit(0), F.lit(1))
    none = F.array(F.lit(0), F.lit(0), F.lit(0))
    assert one(spark, V.pool_mean("t", m), t=t) == [3, 1] and one(spark, V.pool_max("t", m), t=t) == [5, 2] and one(spark, V.pool_cls("t"), t=t) == [1, 2]
    assert one(spark, V.pool_mean("t", none), t=t) == [3, 2] and one(spark, V.pool_max("t", none), t=t) == [5, 4]
    assert one(spark, V.pool_mean("t", none, "zero"), t=t) == [0, 0] and one(spark, V.pool_max("t", none, "zero"), t=t) == [0, 0]
    w = F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0))
    assert one(spark, V.pool_attention("t", w), t=t) == pytest.approx([14 / 4, 6 / 4])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3, width=32), min_size=1, max_size=40))
def test_quantization_bounds(v):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    d = spark.createDataFrame([(v,)], "v array<float>").withColumn("q", V.int8("v")).withColumn("h", V.int4("v")).withColumn("b", V.binary("v"))
    r = d.select("q", "h", V.dequantized(F.col("q.codes"), F.col("q.scale")).alias("back"), V.unpacked_nibbles(V.packed_nibbles(F.col("h.codes")), F.size("v")).alias("nibbles"), V.from_binary(F.col("b"), F.size("v")).alias("signs"), V.quantization_error("v", V.dequantized(F.col("q.codes"), F.col("q.scale"))).alias("e")).first()
    x = np.array(v, np.float32).astype(float)
    assert np.abs(np.array(r.back) - x).max() <= r.q.scale / 2 + 1e-9
    assert r.nibbles == r.h.codes and set(r.h.codes) <= set(range(1, 16))
    assert r.signs == [1.0 if t > 0 else -1.0 for t in x]
    assert r.e.mean_abs <= r.e.max_abs + 1e-12


def matrix_like(n, d, seed=0xDEADBEEF):
    out, s = [], seed
    for _ in range(n * d):
        s = (s * 2862933555777941757 + 3037000493) % 2**64
        out.append(((s >> 33) & 0xFFFFFFFF) / (2**32 - 1) * 2 - 1)
    return np.array(out).reshape(n, d)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_similarity_matrix_invariants(spark):
    x = matrix_like(40, 16)
    x[7] = 0
    m = np.zeros((40, 40))
    for r in search.similarity_matrix(frame(spark, x), tile=16).collect():
        m[r.row_id, r.col_id] = r.similarity
    y = x.astype(np.float32).astype(float)
    n = np.linalg.norm(y, axis=1)
    want = np.where((n[:, None] > 0) & (n[None, :] > 0), y @ y.T / np.maximum(np.outer(n, n), 1e-30), 0)
    assert np.allclose(m, want, atol=1e-6) and np.allclose(m, m.T)
    assert search.similarity_matrix(frame(spark, x), diagonal_one=True, tile=16).where("row_id = 7 and col_id = 7").first().similarity == 1


@pytest.mark.parametrize("metric", list(Metric))
def test_knn_paths_agree(spark, metric):
    x = matrix_like(60, 8).round(1)  # many ties
    store = frame(spark, x)
    q = store.where("vec_id < 7")
    key = lambda rows: sorted((r.query_id, r.rank, r.id, round(r.distance, 9)) for r in rows)
    a = key(search.knn(store, q, 5, metric, skip_self=True).collect())
    y = x.astype(np.float32).astype(float)
    want = []
    for i in range(7):
        d = search.distances(y[i : i + 1], y, metric)[0]
        order = sorted((round(d[j], 12), j) for j in range(60) if j != i)[:5]
        want += [(i, k + 1, j, round(t, 9)) for k, (t, j) in enumerate(order)]
    assert a == sorted(want)
    s = store.selectExpr("vec_id as id", "embedding as v")
    assert key(search.ranked(search.blocked(s, s.where("id < 7"), 3, metric, 5, True, blocks=4), 5, metric).collect()) == a
    names = {Metric.EUCLIDEAN: V.squared_euclidean}
    e = store.crossJoin(q.selectExpr("vec_id as query_id", "embedding as q")).where("vec_id <> query_id").withColumn("d", names[metric]("q", "embedding") if metric in names else V.distance("q", "embedding", metric))
    col = {(r.query_id, r.vec_id): r.d for r in e.select("query_id", "vec_id", "d").collect()}
    assert all(col[q_, i] == pytest.approx(t, abs=1e-9) for q_, _, i, t in a)


def test_knn_edges(spark):
    store = frame(spark, matrix_like(10, 4))
    assert search.knn(store, store, 0).count() == 0 and search.knn(store, store.limit(0), 3).count() == 0
    assert search.knn(store, store.limit(1), 99).count() == 10
    assert search.knn(store.limit(0), store, 3).count() == 0
    bad = store.unionByName(spark.createDataFrame([(99, [1.0])], "vec_id long, embedding array<float>"))
    with pytest.raises(Exception, match="has not 4 elements"):
        search.knn(bad, store.limit(1), 3, dim=4).collect()
    assert search.search(store, [0.1, 0.2, 0.3, 0.4], 3).count() == 3


def test_ivf_recall_rises_to_one(spark):
    store = frame(spark, matrix_like(200, 8))
    c = search.train_centroids(store, 8, 5)
    assert c.shape == (8, 8)
    assigned, q = search.ivf_assign(store, c), store.where("vec_id < 20")
    exact = search.knn(store, q, 10, Metric.EUCLIDEAN)
    got = [search.recall(search.ivf_search(assigned, q, c, p, 10), exact).agg(F.avg("recall")).first()[0] for p in (1, 4, 8)]
    assert got[0] <= got[1] <= got[2] == 1
