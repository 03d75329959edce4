"""Tests of what was changed after the findings of round 4."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, search


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_descent_ends_after_few_tables(spark, monkeypatch):
    """Before, it went on by rounds until hardly an edge changed, and began in stretches of two pools: a dozen tables of edges on vectors without clusters."""
    tables, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, path=None: (tables.append(path), plain(df, path))[1])
    x = np.random.default_rng(6).normal(size=(2000, 48))
    e = frame(spark, x)
    exact = {(r[0], r[1]) for r in graph.knn_graph(e, 5).select("src", "dst").collect()}
    got = graph.descended(e, 5, pool=8, starts=2).collect()
    assert len(got) == 10_000 and len({(r["src"], r["dst"]) for r in got} & exact) >= 0.95 * len(exact)
    assert all(abs(r["distance"] - np.sqrt(((x[r["src"]] - x[r["dst"]]) ** 2).sum())) < 1e-12 for r in got[::50])
    assert sum("edges" in (p or "") or "wide" in (p or "") for p in tables) <= 8


def test_members_around_many_nodes_meet_in_one_product(spark, monkeypatch):
    """Groups of several sizes, members named twice, limits, and groups that go over several Arrow batches."""
    rng = np.random.default_rng(7)
    x, far = rng.integers(-3, 4, (60, 5)).astype(float), rng.choice([4.0, 30.0, np.inf], 60)
    x[10] *= 1e200  # whose square overflows
    around = [(mid, int(i)) for mid in range(25) for i in rng.integers(0, 60, rng.integers(1, 40))]
    want = {}
    with np.errstate(over="ignore"):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
    for mid in range(25):
        own = sorted({i for m, i in around if m == mid})
        want |= {(i, j): d[i, j] for i in own for j in own if i != j and d[i, j] <= far[i]}
    monkeypatch.setattr(graph, "HELD_PAIRS", 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(m, i, x[i].tolist(), float(far[i])) for m, i in around], "mid long, id long, v array<double>, far double")
        got = graph.met_around(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["src"], r["dst"]): r["d"] for r in got} == want


def test_stretches_are_even_and_hold_all(spark):
    x = np.random.default_rng(8).normal(size=(500, 6))
    x[100:400] = x[100]  # copies lie on the same side of everything
    nodes = frame(spark, x).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(1.0).alias("far"))
    got = graph.stretches(nodes, 500, x.mean(0), np.random.default_rng(9).normal(size=(3, 7, 6)), 64).collect()
    sizes = {}
    for r in got:
        sizes[r["draw"], r["stretch"]] = sizes.get((r["draw"], r["stretch"]), 0) + 1
    assert len(sizes) == 3 * 8 and max(sizes.values()) <= 64 and min(sizes.values()) >= 60
    assert sorted((r["draw"], r["id"]) for r in got) == [(t, i) for t in range(3) for i in range(500)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot", "manhattan"])
def test_nearest_keeps_to_a_limit(metric, monkeypatch):
    monkeypatch.setattr(search, "TILE_QUERIES", 16)
    monkeypatch.setattr(search, "TILE_ROWS", 50)
    x, ids = np.random.default_rng(10).integers(-2, 3, (200, 4)).astype(float), np.arange(200)
    q, i, d = search.nearest(ids, x, ids, x, metric, 12, True)
    far = np.where(ids % 3 == 0, np.inf, d.reshape(200, 12)[:, 4])
    near = d <= far[q]
    got = search.nearest(ids, x, ids, x, metric, 12, True, far)
    assert all(np.array_equal(a, b[near]) for a, b in zip(got, (q, i, d), strict=True))


@pytest.mark.parametrize("both", [False, True])
def test_rounded_similarities_are_whole_and_in_order(both, monkeypatch):
    """Before, rows came tile by tile, and a file of rounded similarities held no runs."""
    rng = np.random.default_rng(11)
    x, y, ids, jds = rng.normal(size=(37, 5)), rng.normal(size=(50, 5)), np.arange(37) * 3, np.arange(50) * 2 + 1001
    y[3], y[4], x[2] = x[0] * 1e200, x[1] * 1e40, np.nan  # infinite, too large for a place, no number
    monkeypatch.setattr(search, "ORDERED", 800)
    monkeypatch.setattr(search, "PIECE", 64)
    with np.errstate(over="ignore", invalid="ignore"):
        want = x @ y.T
    pieces = list(search.similarities(ids, x, jds, y, search.Metric.DOT, False, 4, both, 3))
    rows = [r for p in pieces for r in zip(*(c.to_pylist() for c in p.columns), strict=True)]
    assert max(p.num_rows for p in pieces) <= 64 and len(rows) == 37 * 50 * (1 + both) == len({r[:2] for r in rows})
    for r, c, s in rows:
        i, j = min(r, c) // 3, (max(r, c) - 1001) // 2
        assert np.isclose(s, want[i, j], rtol=1e-12, atol=0.5001e-3, equal_nan=True) and (not abs(s) < 1e9 or s == round(s, 3))
    turns = sum(a[2] > b[2] for a, b in zip(rows, rows[1:], strict=False))
    assert turns <= 8 * (1 + both) * -(-37 * 50 // 800) * 2


def test_ordered_similarities_are_the_rounded_ones(spark):
    x = np.random.default_rng(12).normal(size=(300, 16))
    x[7], x[8] = 0, x[9]
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("row_id", "col_id", "similarity").cast("decimal(38,0)"))).first()
    few = frame(spark, x[::7])
    for rows, columns in ((frame(spark, x), None), (few, frame(spark, x))):
        plain = search.similarity_matrix(rows, columns, tile=16).withColumn("similarity", F.round("similarity", 6))
        assert digest(plain) == digest(search.similarity_matrix(rows, columns, tile=16, digits=6))
