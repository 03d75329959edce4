"""Stores kept by cells, their log, and what else round 3 added."""

import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import models
from lodestone.functions.vectors import Metric
from lodestone.operators import cells, rerank, search, store, wal
from lodestone.plans import catalogue
from lodestone.plans.config import IndexConfig
from lodestone.sources.shared import Files

D = "/root/testdata/sf0.001"
ROW = "id string, vector array<float>, text string, metadata map<string,string>"


def same(spark, name, d=D):
    """The query's rows are those of its SQL."""
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(catalogue.ORACLES[name]).fetchall()
    names = [x[0] for x in con.description]
    got = catalogue.QUERIES[name](spark, d)
    assert sorted(got.columns) == sorted(names)
    got = [tuple(r[n] for n in names) for r in got.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def clustered(n, dim, groups, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim)) * 4
    return centres[r.integers(0, groups, n)] + r.normal(size=(n, dim)) * 0.3


def vector_rows(spark, x):
    return spark.createDataFrame([(f"{i:06d}", [float(v) for v in row]) for i, row in enumerate(x)], "id string, vector array<float>")


# Log


def test_put_takes_a_name_once(spark, tmp_path):
    files = Files(spark)
    assert files.put(f"file://{tmp_path}/a/b.json", "1") and not files.put(f"file://{tmp_path}/a/b.json", "2")
    assert files.read(f"file://{tmp_path}/a/b.json") == "1" and list(files.names(f"file://{tmp_path}/a")) == ["b.json"]


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    done = []

    def write(name):
        log = wal.Log(spark, path, "id string, n int")
        for k in range(4):
            done.append(log.append(spark.createDataFrame([(f"{name}{k}", i) for i in range(5)], "id string, n int"), F.col("n")))

    threads = [threading.Thread(target=write, args=(x,)) for x in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [(5 * i, 5 * i + 4) for i in range(8)]
    rows = wal.Log(spark, path, "id string, n int").read().orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(40)) and [r["n"] for r in rows] == [0, 1, 2, 3, 4] * 8
    assert {r["id"] for r in rows} == {f"{x}{k}" for x in "ab" for k in range(4)}


def test_reads_are_pruned_and_the_log_is_cut(spark, tmp_path):
    log = wal.Log(spark, f"file://{tmp_path}/log", "n int")
    for k in range(4):
        log.append(spark.range(3).select((F.col("id") + 10 * k).cast("int").alias("n")), F.col("n"))
    assert log.append(spark.range(0).select(F.col("id").cast("int").alias("n")), F.col("n")) is None
    late = log.read(5)
    assert sorted((r["seq"], r["n"]) for r in late.collect()) == [(6 + i, x) for i, x in enumerate([20, 21, 22, 30, 31, 32])]
    assert len({f.split("/")[-2] for f in late.inputFiles()}) == 2
    assert log.truncate(5) == 2 and log.statistics(5)["segments"] == 2 and log.statistics(5)["rows"] == 6
    assert sorted(Files(spark).names(f"{log.path}/commits")) == [f"{n:020d}.json" for n in (3, 6, 9)]
    fresh = wal.Log(spark, log.path, "n int")
    assert fresh.last(5) == 11 and fresh.append(spark.range(1).select(F.lit(7).alias("n")), F.lit(0), 5) == (12, 12)
    assert log.last(5) == 12  # another writer's commit is found from the last known one


def test_a_commit_reads_no_more_than_the_commits_behind_the_last_known(spark, tmp_path, monkeypatch):
    log, asked = wal.Log(spark, f"file://{tmp_path}/log", "n int"), []
    for _ in range(3):
        log.append(spark.range(2).select(F.lit(1).alias("n")), F.lit(0))
    real = wal.Log.commit_at
    monkeypatch.setattr(wal.Log, "commit_at", lambda self, first: asked.append(first) or real(self, first))
    log.append(spark.range(2).select(F.lit(1).alias("n")), F.lit(0))
    assert asked == [6]


# Store


def test_checkpoint_cuts_the_log_and_one_of_two_wins(spark, tmp_path):
    s = store.VectorStore.create(spark, f"file://{tmp_path}/s", IndexConfig(2))
    with pytest.raises(store.StoreError):
        store.VectorStore.create(spark, s.path, IndexConfig(2))
    s.append(spark.createDataFrame([("a", [1.0, 0.0], "x", None), ("b", [0.0, 1.0], "y", None), ("a", [0.5, 0.5], "z", None)], ROW).withColumn("seq", F.monotonically_increasing_id()))
    assert s.log_statistics() | {"bytes": 0} == {"segments": 1, "rows": 3, "bytes": 0, "first": 0, "last": 2}
    old = s._state()
    assert s.checkpoint(grace=0) and s.log_statistics()["segments"] == 0 and s.flush() == 2
    assert not s._write(s.rows(), old, 2)  # made from a state that is no longer the newest
    s.delete(spark.createDataFrame([("b",)], "id string"))
    other = store.VectorStore.load(spark, s.path)
    other.append(spark.createDataFrame([("c", [1.0, 1.0], None, None)], ROW))
    assert sorted(r["id"] for r in s.rows().collect()) == ["a", "c"]
    for _ in range(3):
        assert other.checkpoint()
    assert sorted((r["id"], r["text"]) for r in s.rows().collect()) == [("a", "z"), ("c", None)]
    assert len([n for n in Files(spark).names(s.path) if n.startswith("data-")]) == 2


def test_recover_removes_what_no_one_names(spark, tmp_path):
    s = store.VectorStore.create(spark, f"file://{tmp_path}/s", IndexConfig(2))
    s.append(spark.createDataFrame([("a", [1.0, 0.0], "x", None)], ROW))
    s.rows().write.parquet(f"{s.path}/log/segments/{'f' * 32}")
    s.rows().write.parquet(f"{s.path}/data-dead/rows")
    assert s.recover()["dropped_segments"] == 0  # young ones may still be written
    got = s.recover(grace=0)
    assert (got["dropped_segments"], got["dropped_snapshots"], got["segments"], got["rows"], got["last"]) == (1, 1, 1, 1, 0)
    assert s.rows().count() == 1


@pytest.mark.parametrize("metric", list(Metric))
def test_search_by_cells_is_exact_for_every_metric(spark, tmp_path, metric):
    x = np.concatenate([clustered(400, 6, 9), np.zeros((2, 6)), clustered(20, 6, 9)[:1].repeat(6, 0)])
    s = store.VectorStore.create(spark, f"file://{tmp_path}/s", IndexConfig(6, "ivf", metric=metric, lists=9, probes=3))
    s.append(vector_rows(spark, x))
    assert s.train(5)
    s.append(spark.createDataFrame([("000003", [9.0] * 6), ("zz", [float(v) for v in x[7]])], "id string, vector array<float>"))
    s.delete(spark.createDataFrame([("000010",)], "id string"))
    now = {r["id"]: np.array(r["vector"], float) for r in s.rows().collect()}
    q = np.concatenate([x[::60], [[0.0] * 6, [5.0] * 6]])
    queries = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(q)], "query_id long, vector array<double>")
    got = s.search_many(queries, 5).collect()
    ids = sorted(now)
    d = search.distances(q, np.array([now[i] for i in ids]), metric)
    for i in range(len(q)):
        want = sorted(zip(d[i].round(9), ids, strict=True))[:5]
        mine = sorted((round(r["distance"], 9), r["id"], r["rank"]) for r in got if r["query_id"] == i)
        assert [m[0] for m in mine] == pytest.approx([w[0] for w in want], abs=1e-6)
        assert metric is Metric.COSINE or [m[1] for m in mine] == [w[1] for w in want]


def test_cells_are_pruned_and_recall_is_high_with_a_quarter_of_them(spark, tmp_path, monkeypatch):
    x = clustered(3000, 16, 40)
    s = store.VectorStore.create(spark, f"file://{tmp_path}/s", IndexConfig(16, "ivf", lists=40, probes=10))
    s.append(vector_rows(spark, x))
    s.train(8)
    read, real = [], cells.pruned
    monkeypatch.setattr(cells, "pruned", lambda rows, wave: read.append(wave.groupBy("id").count().agg(F.sum("count")).first()[0] or 0) or real(rows, wave))
    q = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x[::50])], "query_id long, vector array<double>")
    for probes in (10, None):
        read.clear()
        got = s.search_many(q, 10, probes=probes).collect()
        d = ((x[::50][:, None] - x[None]) ** 2).sum(2)
        hits = sum(int(r["id"]) in set(np.argsort(d[r["query_id"]], kind="stable")[:10]) for r in got)
        assert hits / (10 * 60) >= (0.9 if probes else 0.999)
        assert sum(read) <= 60 * 10  # a quarter of the cells
    plan = real(s._snapshot(s._state()), spark.createDataFrame([(1, 3)], "id long, cell int"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "cell#" in plan


def test_search_by_cells_with_filters_and_few_rows(spark, tmp_path):
    x = clustered(300, 4, 5)
    s = store.VectorStore.create(spark, f"file://{tmp_path}/s", IndexConfig(4, "ivf", lists=5, probes=1))
    assert not s.train() and not s.is_trained
    s.append(vector_rows(spark, x).withColumn("metadata", F.create_map(F.lit("odd"), (F.col("id").cast("int") % 97 == 1).cast("string"))))
    s.train(3)
    q = spark.createDataFrame([(0, [float(v) for v in x[0]]), (1, None)], "query_id long, vector array<double>")
    got = s.search_many(q, 10, where=F.col("metadata")["odd"] == "true").collect()
    assert sorted(r["id"] for r in got) == ["000001", "000098", "000195", "000292"]
    assert s.search_many(q, 0).count() == 0 and s.search_many(q, 1000).count() == 300 and s.search_many(q.limit(0), 3).count() == 0


def test_texts_are_stored_found_and_reranked(spark, tmp_path):
    model = models.HashEmbedder(64)
    s = store.VectorStore.create(spark, f"file://{tmp_path}/s", IndexConfig(64, metric=Metric.COSINE))
    texts = ["the quick brown fox", "the quick brown fox", "a lazy dog sleeps", "foxes are quick and brown", "", None]
    s.add_texts(spark.createDataFrame([(f"t{i}", t, {"n": str(i)}) for i, t in enumerate(texts)], "id string, text string, metadata map<string,string>"), model)
    s.add_texts(spark.createDataFrame([("no id given",)], "text string"), model)
    assert s.rows().count() == 7
    hits = s.search_text("the quick brown fox", model, 3).collect()
    assert [h["id"] for h in sorted(hits, key=lambda h: h["rank"])] == ["t0", "t1", "t3"] and hits[0]["text"] == "the quick brown fox"
    diverse = s.search_text("the quick brown fox", model, 2, strategy=rerank.diversity(0.3)).collect()
    assert [h["id"] for h in sorted(diverse, key=lambda h: h["rank"])][0] == "t0" and "t1" not in {h["id"] for h in diverse}
    many = s.search_texts(spark.createDataFrame([(7, "lazy dog"), (8, "brown foxes")], "query_id long, text string"), model, 1, where=F.col("text").isNotNull(), strategy=rerank.exact())
    assert {r["query_id"]: r["id"] for r in many.collect()} == {7: "t2", 8: "t3"}


@pytest.mark.parametrize("name", ["store_recover", "store_ivf_search"])
def test_queries_are_their_sql(spark, name):
    same(spark, name)


# Ranks and measures


def skewed(spark, n=4000):
    r = np.random.default_rng(1)
    rows = [("hot" if i % 4 else (None if i % 8 else f"g{i % 5}"), float(r.integers(0, 50)) if i % 11 else None, i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v double, seq long"), rows


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_positions_of_a_skewed_group(spark):
    from lodestone.operators import ranks

    df, rows = skewed(spark)
    got = ranks.numbered(df, ["g"], [F.col("v").desc_nulls_last(), F.col("seq")])
    assert "part" in plan_of(got) and got.columns == ["g", "v", "seq", "position"]
    want = {}
    for g in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[1] if r[1] is not None else -1), r[2]))):
            want[r[2]] = i + 1
    assert {r["seq"]: r["position"] for r in got.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = ranks.placed(df.repartition(8), ["g"], ["seq"]).where("g = 'hot'").select("part").distinct().count()
    assert parts > 2  # one group lies in many partitions
    assert ranks.placed(df.withColumn("seq", F.lit(1)), ["g"], ["seq"]).where("g = 'hot'").select("part").distinct().count() > 2
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranks.numbered(df.limit(0), ["g"], ["seq"]).count() == 0


def test_percentiles_of_a_skewed_group(spark):
    from lodestone.operators import measures

    df, rows = skewed(spark)
    got = {(r["g"], r["percentile"]): r["value"] for r in measures.percentiles(df, "v", ["g"], [0.0, 37.5, 50.0, 99.9, 100.0]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        vs = sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
        for p in (0.0, 37.5, 50.0, 99.9, 100.0):
            want[g, p] = vs[int((len(vs) - 1) * p / 100)]
    assert got == want
    whole = measures.percentiles(df, "v", [], [50.0]).first()
    assert whole["value"] == sorted(r[1] for r in rows if r[1] is not None)[(sum(r[1] is not None for r in rows) - 1) // 2]


def test_concurrency_is_the_plain_sweep(spark):
    from lodestone.operators import measures

    r = np.random.default_rng(2)
    spans = [("a" if i % 3 else "b", int(s), int(s + r.integers(0, 40))) for i, s in enumerate(r.integers(0, 500, 300))]
    df = spark.createDataFrame([*spans, ("a", None, 3), ("a", 9, 2), ("c", 5, 5)], "g string, s long, e long")
    got = {x["g"]: x for x in measures.concurrency(df, "s", "e", ["g"]).collect()}
    for g in "ab":
        mine = [x for x in spans if x[0] == g]
        at = range(min(x[1] for x in mine), max(x[2] for x in mine))
        level = [sum(s <= t < e for _, s, e in mine) for t in at]
        assert (got[g]["spans"], got[g]["peak"], got[g]["busy"], got[g]["whole"]) == (len(mine), max(level), sum(x > 0 for x in level), len(at))
        assert got[g]["mean"] == pytest.approx(sum(level) / len(at))
    assert (got["c"]["peak"], got["c"]["mean"], got["c"]["busy"]) == (0, 0.0, 0)
    assert measures.concurrency(df.where("g <> 'c'"), "s", "e").first()["spans"] == 300


def test_sketches_merge_in_any_order(spark):
    from lodestone.operators import measures

    r = np.random.default_rng(3)
    values = np.sort(r.gamma(2, 10, 20_000))
    rows = spark.createDataFrame([(float(v), int(i) * 7) for i, v in enumerate(r.permutation(values))], "v double, t long").withColumn("ts", F.timestamp_seconds("t"))
    hourly = measures.sketches(rows, "v", [], "ts").cache()
    assert hourly.count() == 39 and hourly.agg(F.max(F.length("sketch"))).first()[0] < 10_000
    for order in (F.col("start"), F.desc("start"), F.rand(1)):
        merged = measures.merged_sketches(hourly.orderBy(order), [])
        for x in measures.sketched_percentiles(merged, []).collect():
            assert x["n"] == 20_000
            rank = np.searchsorted(values, x["value"]) / len(values)
            assert abs(rank - x["percentile"] / 100) <= measures.SKETCH_ERROR + 1e-3
    moving = measures.moving_sketches(hourly, [], 3).orderBy("start").collect()
    counts = [x["n"] for x in hourly.orderBy("start").collect()]
    assert [x["n"] for x in moving] == [sum(counts[max(0, i - 2) : i + 1]) for i in range(39)]
    hourly.unpersist()


@pytest.mark.parametrize("name", ["latency_sketch", "stage_concurrency", "stage_metrics", "latency_percentiles", "priority_batches", "latest_window"])
def test_measures_are_their_sql(spark, name):
    same(spark, name)


# Model runs


class Watched(models.ModularModel):
    """Fails where a batch is too large, and gives nonsense where the mask is False."""

    def run(self, ids, mask):
        assert ids.shape[1] % 4 == 0 and len(ids) <= 5 and ids.size <= 80 or len(ids) == 1
        return np.where(mask[:, :, None], super().run(ids, mask), np.nan)


@pytest.mark.parametrize("pooling", ["mean", "max", "cls", "attention"])
def test_padding_takes_no_part(spark, pooling):
    from lodestone.plans.config import BatchConfig, EmbeddingConfig

    r = np.random.default_rng(5)
    rows = [(f"k{i}", [int(x) for x in r.integers(0, 3000, int(n))]) for i, n in enumerate(r.integers(0, 60, 120))] + [("null", None)]
    df = spark.createDataFrame(rows, "k string, ids array<int>").repartition(3)
    run = models.run_model(df, Watched(5), "ids", "k", EmbeddingConfig(40, "middle", pooling=pooling, normalize=False), BatchConfig(5, bucket=4, max_tokens=80))
    got = {x["k"]: x for x in run.collect()}
    assert len(got) == len(rows)
    for k, ids in rows:
        ids = ids or []
        own = ids if len(ids) <= 40 else ids[:20] + ids[-20:]
        out = models.ModularModel(5).run(np.array([own or [0]]), None)[0]
        want = {"max": out.max(0), "cls": out[0]}.get(pooling, out.mean(0)) if own else np.zeros(5)
        assert np.allclose(got[k]["vector"], want)
        assert (got[k]["tokens"], got[k]["truncated"], got[k]["padded"]) == (len(own), len(ids) > 40, max(4, -(-len(own) // 4) * 4))
    assert max(x["batch_rows"] for x in got.values()) > 1


def test_model_runs_fail_plainly(spark):
    from lodestone.plans.config import EmbeddingConfig

    class Wrong(models.ModularModel):
        def run(self, ids, mask):
            return np.zeros((1, 1, 1))

    df = spark.createDataFrame([(1, [1, 2, 3])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="InferenceFailed"):
        models.run_model(df, Wrong()).collect()
    with pytest.raises(Exception, match="InputTooLong"):
        models.run_model(df, models.ModularModel(), config=EmbeddingConfig(2, "none")).collect()
    assert models.run_model(df.limit(0), models.ModularModel()).count() == 0


def test_what_waits_is_bounded():
    from lodestone.plans.config import BatchConfig

    gather, out, most = models.MicroBatches(BatchConfig(1000, bucket=8), hold=200), [], 0
    for i in range(300):
        out += list(gather.add(i % 50, i))
        most = max(most, gather.held)
    out += list(gather.rest())
    assert most <= 200 and sorted(x for _, rows in out for x in rows) == list(range(300))


def test_presets():
    from lodestone import errors
    from lodestone.plans import config

    assert len(config.PIPELINE) == 13 and config.PIPELINE["large"].batch.max_batch == 24 and config.large_model(8192).batch.max_batch == 8
    assert config.PIPELINE["memory_efficient"].batch_by_pressure() == ((0.3, 8), (0.6, 4), (0.8, 2), (1.0, 4))
    assert config.PIPELINE["default"].with_memory_budget(1).batch_by_pressure()[-1] == (1.0, 1)
    assert config.PIPELINE["real_time"].batch.wait() == 0.2 and config.PIPELINE["default"].with_cache().cache.max_entries == 100_000
    for bad in ({"max_batch": 4, "min_batch": 5}, {"max_tokens": 0}, {"padding_ratio": 1.5}):
        with pytest.raises(errors.InvalidConfiguration):
            config.BatchConfig(**bad)


def test_managed_models_count_what_they_embed(spark):
    from lodestone import errors

    r = models.Registry()
    r.register("broken", lambda: 1 / 0)
    with pytest.raises(errors.ModelLoadFailed):
        r.load("broken")
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    assert r.metrics("hash")["runs"] == 0
    assert len(r.embed("hash", df).collect()) == 20 and len(r.embed("hash", df.limit(5)).collect()) == 5
    assert r.metrics("hash") == {"runs": 2, "rows": 25, "mean_length": pytest.approx(1, abs=1e-6), "zeros": 0}
    r.unload_all()
    assert not r.loaded


@pytest.mark.parametrize("name", ["model_run", "model_padding"])
def test_model_queries_are_their_sql(spark, name):
    same(spark, name)


# Neighbour graphs and projection


def test_descent_finds_the_neighbours(spark):
    from lodestone.operators import graph

    e = spark.read.parquet(f"{D}/embeddings.parquet")
    exact = {(r["src"], r["dst"]) for r in graph.knn_graph(e, 10).collect()}
    got = graph.descended(e, 10).collect()
    assert len(got) == len(exact) and sum((r["src"], r["dst"]) in exact for r in got) >= 0.95 * len(exact)
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [3.0]), (4, None)], "vec_id long, embedding array<double>")
    assert sorted((r["src"], r["rank"], r["dst"], r["distance"]) for r in graph.descended(few, 1).collect()) == [(1, 1, 2, 1.0), (2, 1, 1, 1.0), (3, 1, 2, 2.0)]
    assert graph.descended(few.limit(0), 3).count() == 0


def test_memberships_are_a_fuzzy_union(spark):
    from lodestone.operators import graph

    r = np.random.default_rng(6)
    x = r.normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = [(i, int(j), float(d[i, j])) for i in range(40) for j in np.argsort(d[i])[1:9]]
    w = {(a["src"], a["dst"]): a["w"] for a in graph.memberships(spark.createDataFrame(near, "src long, dst long, distance double")).collect()}
    own = {}
    for i in range(40):
        e = [(j, v) for a, j, v in near if a == i]
        low, high, least = 1e-9, 1e9, min(v for _, v in e)
        for _ in range(200):
            sigma = (low * high) ** 0.5
            low, high = (low, sigma) if sum(np.exp(-(v - least) / sigma) for _, v in e) > 3 else (sigma, high)
        own |= {(i, j): float(np.exp(-(v - least) / sigma)) for j, v in e}
    pairs = {*own, *((b, a) for a, b in own)}
    assert set(w) == pairs
    for a, b in pairs:
        u, v = own.get((a, b), 0), own.get((b, a), 0)
        assert w[a, b] == pytest.approx(u + v - u * v, abs=1e-6)


def test_spectral_vectors_are_the_graphs(spark):
    from lodestone.operators import graph

    r = np.random.default_rng(7)
    n = 30
    a = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            if (i < n // 2) == (j < n // 2) and r.random() < 0.4 or abs(i - j) == 1:
                a[i, j] = a[j, i] = 0.2 + r.random() if (i < n // 2) == (j < n // 2) else 0.05
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "s long, t long, w double")
    got = np.array([[x["p0"]] for x in graph.spectral(edges, edges.select(F.col("s").alias("num")).distinct(), 1, steps=60).orderBy("num").collect()])[:, 0]
    s = np.sqrt(a.sum(1))
    value, vector = np.linalg.eigh(a / s[:, None] / s[None])
    assert abs(np.corrcoef(got, vector[:, -2])[0, 1]) > 0.99


def test_a_spectral_start_is_better_than_a_random_one(spark):
    from lodestone.operators import graph
    from lodestone.plans.config import ProjectionConfig

    x = clustered(200, 8, 6, seed=3)
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    config = ProjectionConfig(neighbours=8, iterations=12)
    spectral, drawn = (graph.trustworthiness(rows, graph.project(rows, config, start=s, approximate=s == "spectral")) for s in ("spectral", "random"))
    assert spectral > drawn + 0.1


def test_descent_query_is_its_sql(spark):
    same(spark, "knn_graph_descent")


# Limiters in streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.unset(key)


def streamed(spark, path, events, parts, name, limiter, **how):
    """What a stream of the events gives that come in `parts` batches."""
    from lodestone.streaming import flow, limiters

    schema = "n long, who string, ts timestamp, c double, r boolean"
    for k, some in enumerate(np.array_split(np.arange(len(events)), parts)):
        rows = spark.createDataFrame([events[i] for i in some], "n long, who string, t double, c double, r boolean")
        rows.select("n", "who", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "c", "r").coalesce(1).write.mode("append").parquet(f"{path}/in")
    out = limiters.limit_stream(flow.texts(spark, f"{path}/in", schema, 1), limiter, "who", "ts", "n", **how)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return {r["n"]: r["allowed"] for r in spark.sql(f"select * from {name}").collect()}


@pytest.mark.parametrize("kind", ["bucket", "fixed", "leaky"])
def test_a_stream_in_batches_is_the_batch(rocks, tmp_path, kind):
    from lodestone.streaming import limiters

    limiter = {"bucket": limiters.TokenBucket(3, 0.2), "fixed": limiters.FixedWindow(3, 20.0), "leaky": limiters.LeakyBucket(2, 7.0)}[kind]
    r = np.random.default_rng(8)
    times = np.sort(r.integers(0, 200, 60)).astype(float)
    events = [(i, "abc"[int(r.integers(0, 3))], float(t), float(r.integers(1, 4)), False) for i, t in enumerate(times)]
    got = streamed(rocks, str(tmp_path), events, 3, f"limited_{kind}", limiter, cost_col="c")
    df = rocks.createDataFrame(events, "n long, who string, t double, c double, r boolean").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    want = {x["n"]: x["allowed"] for x in limiters.limit(df, limiter, "who", "ts", "n", "c").collect()}
    assert got == want and len(set(want.values())) == 2
    states = {x["id"]: x["last"] for x in limiters.limiter_states(rocks, f"{tmp_path}/c").collect()}
    assert states == {w: max(e[2] for e in events if e[1] == w) for w in "abc"}


def test_idle_identifiers_leave_the_state_and_resets_start_anew(rocks, tmp_path):
    from lodestone.streaming import limiters

    events = [(0, "a", 0.0, 1.0, False), (1, "a", 1.0, 1.0, False), (2, "b", 1.0, 1.0, False), (3, "a", 2.0, 1.0, True), (4, "a", 3.0, 1.0, False), (5, "b", 90.0, 1.0, False), (6, "b", 91.0, 1.0, False), (7, "c", 200.0, 1.0, False), (8, "c", 201.0, 1.0, False)]
    events = [(n, who, 1000 + t, c, r) for n, who, t, c, r in events]  # a watermark begins at 0
    got = streamed(rocks, str(tmp_path), events, 9, "limited_idle", limiters.TokenBucket(1, 0.0), reset_col="r", idle=60.0)
    assert got == {0: True, 1: False, 2: True, 3: True, 4: False, 5: True, 6: False, 7: True, 8: False}
    assert [x["id"] for x in limiters.limiter_states(rocks, f"{tmp_path}/c").collect()] == ["c"]


# Cache in a stream


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    from lodestone.operators import cache
    from lodestone.streaming import flow

    t = cache.CacheTable(spark, f"file://{tmp_path}/cache", models.HashEmbedder(8))
    made = lambda *rows: spark.createDataFrame([(x, s) for x, s in rows], "text string, s long").withColumn("at", F.timestamp_seconds("s"))
    assert t.rows().count() == 0
    assert t.take(made(("a", 1), ("A ", 3), ("b", 2), (None, 9)), 0)
    assert not t.take(made(("a", 1), ("A ", 3), ("b", 2)), 0)
    before = sorted(map(tuple, t.rows().select("text", "access_count", "accessed_at").collect()))
    assert [(x[0], x[1]) for x in before] == [("A ", 2), ("b", 1)] or [(x[0], x[1]) for x in before] == [("a", 2), ("b", 1)]
    assert t.take(made(("a", 50), ("c", 60)), 1) and t.take(made(("c", 5)), 0, stream="other")
    got = {r["text"].strip().lower(): (r["access_count"], r["accessed_at"].timestamp()) for r in t.rows().collect()}
    assert got == {"a": (3, 50.0), "b": (1, 2.0), "c": (2, 60.0)}
    old = t.state()
    with pytest.raises(cache.CacheError):
        t._put(t.rows(), old | {"version": old["version"] - 1}, {})
    small = cache.CacheTable(spark, f"file://{tmp_path}/cache", models.HashEmbedder(8), ttl=30.0)
    small.take(made(("d", 70)), 2)
    assert sorted(r["text"].strip().lower() for r in small.rows().collect()) == ["a", "c", "d"]
    made(("e", 80), ("e", 81)).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = t.follow(flow.texts(spark, f"{tmp_path}/in", "text string, s long, at timestamp"), f"{tmp_path}/check", "follower")
    q.awaitTermination(200)
    assert t.rows().where("text = 'e'").first()["access_count"] == 2 and t.state()["batches"]["follower"] == 0


@pytest.mark.parametrize("name", ["cache_stream", "cache_size_evict"])
def test_cache_queries_are_their_sql(spark, name):
    same(spark, name)


# Tokenizers


@pytest.mark.parametrize("name", ["wordpiece_encode", "sentencepiece_encode"])
def test_tokenizer_queries_are_their_sql(spark, name):
    same(spark, name)


def test_byte_bpe_is_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.operators import tokenizers

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    odd = ["it's we'LL 12345 \n\n  x\t ", "\U0001f600é́ ‍ 漢字かな", "<|endoftext|> def f(x):\n    return x", "", "a" * 3000, "\x00\x1f\x7f\xa0 \x85", "١٢٣ ½ Ⅷ"]
    docs = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = {r["doc_id"]: r["ids"] for r in tokenizers.encode(docs, catalogue.public_bpe(spark), tokenizers.Options(0, special_tokens=False)).collect()}
    rows = docs.collect()
    for r, e in zip(rows, theirs.encode_batch([r["text"] for r in rows], add_special_tokens=False), strict=True):
        assert got[r["doc_id"]] == e.ids, r["doc_id"]


# Vectors, names and limits


def test_buffers_are_extracted_by_shape(spark):
    from lodestone.functions import vectors as V

    df = spark.createDataFrame([([float(i) for i in range(12)],)], "f array<float>")
    get = lambda *how: df.select(V.extracted("f", *how)).first()[0]
    assert get("vector") == list(range(12)) and get("scalar") is None and get("matrix", 3, 4)[2] == [8, 9, 10, 11]
    assert get("tensor", 2, 3, 2)[1] == [[6, 7], [8, 9], [10, 11]] and get("similarities", 3) is None and get("concatenated", 5, 7)[1] == [5, 6, 7, 8, 9, 10, 11]
    assert df.select(V.extracted(F.slice("f", 1, 9), "similarities", 3)).first()[0][1] == [3, 4, 5]
    assert df.select(V.extracted(F.slice("f", 2, 1), "scalar")).first()[0] == 1


def test_stable_norms(spark):
    from lodestone.functions import vectors as V

    df = spark.createDataFrame([([1e200, 1e200],), ([3e-200, 4e-200],), ([0.0, 0.0],), ([],), ([1e20, 1.0, -1e20, 1e-3],)], "v array<double>")
    assert [r[0] for r in df.select(V.stable_norm("v")).collect()][:4] == [pytest.approx(2**0.5 * 1e200), pytest.approx(5e-200), 0.0, 0.0]
    assert [r[0] for r in df.select(V.normalize_stable("v", "first")).collect()][:4] == [pytest.approx([0.5**0.5] * 2), pytest.approx([0.6, 0.8]), [1.0, 0.0], []]
    assert [r[0] for r in df.select(V.normalize_stable("v", "null")).collect()][2] is None and [r[0] for r in df.select(V.normalize_stable("v")).collect()][2] == [0.0, 0.0]
    assert df.select(V.stable_total("v")).collect()[4][0] == 1.001


def test_status_of_every_limiter(spark):
    from lodestone.streaming import limiters

    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3)], "who string, t long, n long").withColumn("ts", F.timestamp_seconds("t"))
    get = lambda limiter, at=None: {r["who"]: (r["remaining"], r["limited"]) for r in limiters.status(df, limiter, "who", "ts", "n", at=at).collect()}
    assert get(limiters.TokenBucket(2, 0.0)) == {"a": (0.0, True), "b": (1.0, False)}
    assert get(limiters.FixedWindow(2, 10.0)) == {"a": (0.0, True), "b": (1.0, False)} and get(limiters.FixedWindow(2, 10.0), "1970-01-01 00:00:10")["a"] == (2.0, False)
    assert get(limiters.LeakyBucket(2, 5.0)) == {"a": (0.0, True), "b": (1.0, False)} and get(limiters.LeakyBucket(2, 5.0), "1970-01-01 00:00:06")["a"] == (1.0, False)


@pytest.mark.parametrize("name", ["normalize_stable", "quantization_ratios", "rate_status", "model_id_parse", "model_family"])
def test_small_queries_are_their_sql(spark, name):
    same(spark, name)


# Bounded searches


@pytest.mark.parametrize("metric", list(Metric))
def test_search_holds_no_more_than_a_tile_of_distances(metric, monkeypatch):
    """Before, all queries met all rows of a batch in one matrix."""
    monkeypatch.setattr(search, "TILE_QUERIES", 7)
    monkeypatch.setattr(search, "TILE_ROWS", 13)
    x = np.random.default_rng(8).integers(-2, 3, (120, 4)).astype(float)
    x[5:30] = x[5]  # copies over several tiles tie to the smaller id
    ids, sizes = np.random.default_rng(9).permutation(120), []
    inner = search.Nearest.about
    monkeypatch.setattr(search.Nearest, "about", lambda self, q, v, norms: (sizes.append(len(q) * len(v)), inner(self, q, v, norms))[1])
    got = search.nearest(ids[:40], x[:40], ids, x, metric, 9, True)
    assert max(sizes) <= 7 * 13
    for i in range(40):
        mine = got[0] == ids[i]
        d = search.distances(x[i : i + 1], x, metric)[0].round(12)
        want = sorted((t, j) for t, j in zip(d, ids, strict=True) if j != ids[i])[:9]
        assert np.allclose(got[2][mine], [t for t, _ in want]) and len(set(got[1][mine])) == 9
        far = want[-1][0]
        assert {j for t, j in want if t < far - 1e-9} <= set(got[1][mine])
        if metric is not Metric.COSINE:  # whose ties depend on rounding where vectors are not equal
            assert [int(j) for _, j in want] == got[1][mine].tolist()


def test_many_queries_are_dealt_into_bounded_blocks():
    for n, dim in ((1, 64), (102_564, 64), (615_384, 64), (100_000, 1536)):
        parts = search.parts_of(n, dim)
        assert n * dim * 8 / parts <= 16 << 20
    assert search.parts_of(102_564, 64) >= 8


def test_similarity_matrix_is_whole_in_blocks_and_sends_few_rows_at_once(spark, monkeypatch):
    """Before, a block's whole matrix was one table and each small tile was shuffled by itself."""
    x = np.random.default_rng(3).normal(size=(50, 4))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    want = unit @ unit.T
    few = frame.where("vec_id % 7 = 0")
    for limit in (search.BROADCAST_BYTES, 0):
        monkeypatch.setattr(search, "BROADCAST_BYTES", limit)
        for got, left in ((search.similarity_matrix(frame, tile=4), range(50)), (search.similarity_matrix(few, frame, tile=4), range(0, 50, 7))):
            rows = got.collect()
            assert sorted((r[0], r[1]) for r in rows) == [(i, j) for i in left for j in range(50)]
            assert np.allclose([r[2] for r in rows], [want[r[0], r[1]] for r in rows])
    assert search.similarity_matrix(few.limit(0), frame).count() == 0
    ids = np.arange(3000)
    pieces = list(search.similarities(ids, np.ones((3000, 2)), ids[:100], np.ones((100, 2)), Metric.DOT, False, 64, True))
    assert max(p.num_rows for p in pieces) <= search.PIECE and sum(p.num_rows for p in pieces) == 600_000


def test_descent_widens_its_pool_until_it_has_found_enough(spark):
    """A pool of the k neighbours alone is too small; before, the descent ended with what it found."""
    from lodestone.operators import graph

    x = np.random.default_rng(4).normal(size=(300, 32))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    exact = {(r[0], r[1]) for r in graph.knn_graph(e, 3).select("src", "dst").collect()}
    share = lambda goal: len({(r[0], r[2]) for r in graph.descended(e, 3, pool=3, rounds=2, starts=1, goal=goal).collect()} & exact) / len(exact)
    assert share(0.0) < 0.8 and share(0.97) >= 0.95


# Embedding


def test_weighted_vectors_make_their_rows_once(spark):
    """Before, chunks were cut and embedded for the weights and for the sums, and joined with themselves."""
    from lodestone.operators import chunking

    got = catalogue.QUERIES["chunk_aggregate_weighted"](spark, D)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0], 1.0), (1, 1, [3.0, 4.0], 3.0), (2, 0, [], 1.0), (3, 0, None, 1.0), (3, 1, [2.0, 0.0], 1.0)], "doc_id long, index int, vector array<double>, w double")
    assert {r[0]: r[1] for r in chunking.aggregate(rows, "weighted", weight_col="w", normalize=False).collect()} == {1: [2.5, 3.5], 3: [1.0, 0.0]}
