"""The registered queries of the engine's own operators, each with the DuckDB SQL of the same rows where SQL can say it.

Queries take whole tables. Searches ask with every vector whose id is divisible by 50, against all. Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import models
from ..functions import text as T
from ..functions import vectors as V
from ..functions.vectors import Metric
from ..operators import batching, cache, chunking, graph, measures, rerank, search, store, tokenizers
from ..plans.config import BatchConfig, EmbeddingConfig, IndexConfig, ProjectionConfig
from ..sources import files
from ..sources.shared import shared_folder, written
from ..streaming import limiters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def asked(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 50 = 0")


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def exploded(df: DataFrame, key: str, vector: str, value: str = "value") -> DataFrame:
    """key, pos, value: arrays in rows, rounded."""
    return df.select(key, F.posexplode(vector).alias("pos", value)).withColumn(value, F.round(F.col(value).cast("double"), 6))


# SQL parts

DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
PER = "list_transform(range(1, len({a}) + 1), lambda i: {f})"
SQL_DISTANCE = {
    Metric.COSINE: "1 - " + DOT + " / (sqrt(" + DOT.replace("{b}", "{a}") + ") * sqrt(" + DOT.replace("{a}", "{b}") + "))",
    Metric.EUCLIDEAN: "list_sum(" + PER.format(a="{a}", f="power({a}[i]::DOUBLE - {b}[i]::DOUBLE, 2)") + ")",
    Metric.DOT: "-" + DOT,
    Metric.MANHATTAN: "list_sum(" + PER.format(a="{a}", f="abs({a}[i]::DOUBLE - {b}[i]::DOUBLE)") + ")",
    Metric.CHEBYSHEV: "list_max(" + PER.format(a="{a}", f="abs({a}[i]::DOUBLE - {b}[i]::DOUBLE)") + ")",
}
SQL_SIMILARITY = {Metric.COSINE: "greatest(0, 1 - d)", Metric.EUCLIDEAN: "exp(-sqrt(d))", Metric.DOT: "(1 - d) / 2", Metric.MANHATTAN: "exp(-d)", Metric.CHEBYSHEV: "exp(-d)"}


def distance_sql(m: Metric, a: str, b: str) -> str:
    return SQL_DISTANCE[m].format(a=a, b=b)


def knn_sql(m: Metric, k: int, where: str = "true", extra: str = "") -> str:
    """WITH ... r: ranked pairs of queries and all rows."""
    return f"""p AS (SELECT q.vec_id AS query_id, s.vec_id AS id, {distance_sql(m, "q.embedding", "s.embedding")} AS d FROM embeddings q JOIN embeddings s ON true WHERE q.vec_id % 50 = 0 AND {where}),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INT AS rank, id, d FROM p QUALIFY rank <= {k})"""


def add_knn(m: Metric) -> None:
    sql = f"WITH {knn_sql(m, 10)} SELECT query_id, rank, id, round(d, 6) AS distance, round({SQL_SIMILARITY[m]}, 6) AS similarity FROM r"

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = vectors(spark, d)
        return rounded(search.knn(e, asked(e), 10, m), "distance", "similarity")

    query(sql, f"knn_{m.value}")(run)


for _m in Metric:
    add_knn(_m)


@query(f"WITH {knn_sql(Metric.COSINE, 10, 's.label <> 3')} SELECT query_id, rank, id, round(d, 6) AS distance FROM r")
def knn_filtered(spark, d):
    e = vectors(spark, d)
    return rounded(search.knn(e, asked(e), 10, Metric.COSINE, where=F.col("label") != 3), "distance").drop("similarity")


@query(f"WITH {knn_sql(Metric.EUCLIDEAN, 10)} SELECT query_id, rank, id, round(d, 6) AS distance FROM r")
def knn_many_queries(spark, d):
    """The search for queries that are too many to send to each task."""
    e = vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    hits = search.blocked(e, e.where("id % 50 = 0"), 3, Metric.EUCLIDEAN, 10, False)
    return rounded(search.ranked(hits, 10, Metric.EUCLIDEAN), "distance").drop("similarity")


_ROW = ", ".join(f"round({distance_sql(m, 'a.embedding', 'b.embedding') if m is not Metric.EUCLIDEAN else 'sqrt(' + distance_sql(m, 'a.embedding', 'b.embedding') + ')'}, 6) AS {m.value}" for m in Metric)


@query(f"SELECT a.vec_id, {_ROW} FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pairwise_distances(spark, d):
    e = vectors(spark, d)
    return rounded(search.pairwise(e, e.withColumn("vec_id", F.col("vec_id") - 1), "vec_id"), *[m.value for m in Metric])


@query("""SELECT vec_id, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total, round(list_min(embedding)::DOUBLE, 6) AS low, round(list_max(embedding)::DOUBLE, 6) AS high,
round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(list_stddev_pop(embedding::DOUBLE[]), 6) AS stddev, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS l2_norm FROM embeddings""")
def vector_stats(spark, d):
    e = vectors(spark, d).withColumn("s", V.statistics("embedding"))
    return e.select("vec_id", F.col("s.count").alias("n"), r6(V.total("embedding")).alias("total"), r6("s.min").alias("low"), r6("s.max").alias("high"), r6("s.mean").alias("mean"), r6("s.stddev").alias("stddev"), r6("s.l2_norm").alias("l2_norm"))


@query("""SELECT vec_id, (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-4) AS normalized, len(list_filter(embedding, lambda x: isnan(x)))::INT AS nan, (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0) AS valid FROM embeddings""")
def vector_validity(spark, d):
    return vectors(spark, d).select("vec_id", V.is_normalized("embedding").alias("normalized"), V.validity("embedding")["nan"].alias("nan"), V.validity("embedding")["valid"].alias("valid"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM s)
SELECT vec_id, (i - 1)::INT AS pos, round(CASE WHEN n > 1e-12 THEN v[i] / n ELSE v[i] END, 6) AS value FROM n, unnest(range(1, len(v) + 1)) AS t(i)""")
def normalize_l2(spark, d):
    e = vectors(spark, d).withColumn("v", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id"))))
    return exploded(e.select("vec_id", V.normalize("v").alias("v")), "vec_id", "v")


@query("""SELECT a.vec_id, (i - 1)::INT AS pos, round((a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE) * 0.5, 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, unnest(range(1, len(a.embedding) + 1)) AS t(i)""")
def vector_arithmetic(spark, d):
    e = vectors(spark, d)
    j = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return exploded(j.select("vec_id", V.scale(V.add("a", "b"), 0.5).alias("v")), "vec_id", "v")


_COS = distance_sql(Metric.COSINE, "a.embedding", "b.embedding")[4:]


@query(f"SELECT a.vec_id AS row_id, b.vec_id AS col_id, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON true")
def similarity_matrix(spark, d):
    return search.similarity_matrix(vectors(spark, d), digits=6)


@query("SELECT a.vec_id AS row_id, b.vec_id AS col_id, round(CASE WHEN a.vec_id = b.vec_id THEN 1 ELSE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6) AS similarity FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 50 = 0")
def similarity_matrix_tiled(spark, d):
    e = vectors(spark, d)
    return search.similarity_matrix(asked(e), e, normalized=True, diagonal_one=True, tile=64, digits=6)


@query(f"WITH {knn_sql(Metric.COSINE, 2)} SELECT query_id, id, round(greatest(0, 1 - d), 6) AS similarity FROM r WHERE rank = 1")
def top1_most_similar(spark, d):
    e = vectors(spark, d)
    return rounded(search.best(search.knn(e, asked(e), 2, Metric.COSINE)), "similarity")


@query(f"WITH {knn_sql(Metric.COSINE, 1, 'q.vec_id <> s.vec_id')} SELECT query_id, (greatest(0, 1 - d) >= 0.5) AS found FROM r")
def contains_similar(spark, d):
    e = vectors(spark, d)
    return search.contains_similar(e, asked(e), 0.5, metric=Metric.COSINE, skip_self=True)


@query(f"WITH {knn_sql(Metric.COSINE, 20)} SELECT query_id, rank, id, round(greatest(0, 1 - d), 6) AS similarity FROM r WHERE greatest(0, 1 - d) >= 0.3")
def similar_above_threshold(spark, d):
    e = vectors(spark, d)
    return rounded(search.find_similar(e, asked(e), 0.3, 20, metric=Metric.COSINE), "similarity").drop("distance")


# Pooling: a sequence is eight vectors of consecutive ids.

_SEQ = "WITH s AS (SELECT vec_id // 8 AS seq, vec_id, embedding, (vec_id % 3 <> 0) AS m, 1 + vec_id % 5 AS w FROM embeddings), u AS (SELECT seq, vec_id, m, w, (i - 1)::INT AS pos, embedding[i]::DOUBLE AS x FROM s, unnest(range(1, len(embedding) + 1)) AS t(i))"


def sequences(spark: SparkSession, d: str) -> DataFrame:
    e = vectors(spark, d).withColumn("seq", F.expr("vec_id div 8"))
    g = e.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("g"))
    return g.select("seq", F.transform("g", lambda x: x["embedding"]).alias("tokens"), F.transform("g", lambda x: (x["vec_id"] % 3 != 0).cast("int")).alias("mask"), F.transform("g", lambda x: (1 + x["vec_id"] % 5).cast("double")).alias("weights"))


@query(_SEQ + " SELECT seq, pos, round(coalesce(avg(x) FILTER (m), avg(x)), 6) AS value FROM u GROUP BY seq, pos")
def pool_mean(spark, d):
    return exploded(models.pooled(sequences(spark, d), "tokens", "mean", "mask", normalize=False), "seq", "vector")


@query(_SEQ + " SELECT seq, pos, round(coalesce(max(x) FILTER (m), max(x)), 6) AS value FROM u GROUP BY seq, pos")
def pool_max(spark, d):
    return exploded(models.pooled(sequences(spark, d), "tokens", "max", "mask", normalize=False), "seq", "vector")


@query(_SEQ + " SELECT seq, pos, round(arg_min(x, vec_id), 6) AS value FROM u GROUP BY seq, pos")
def pool_cls(spark, d):
    return exploded(models.pooled(sequences(spark, d), "tokens", "cls", normalize=False), "seq", "vector")


@query(_SEQ + " SELECT seq, pos, round(sum(x * w) / sum(w), 6) AS value FROM u GROUP BY seq, pos")
def pool_attention(spark, d):
    return exploded(models.pooled(sequences(spark, d), "tokens", "attention", weights_col="weights", normalize=False), "seq", "vector")


@query(_SEQ + ", p AS (SELECT seq, pos, coalesce(avg(x) FILTER (m), avg(x)) AS x FROM u GROUP BY seq, pos), n AS (SELECT seq, sqrt(sum(x * x)) AS n FROM p GROUP BY seq) SELECT seq, pos, round(x / n, 6) AS value FROM p JOIN n USING (seq)")
def pool_mean_normalized(spark, d):
    return exploded(models.pooled(sequences(spark, d), "tokens", "mean", "mask"), "seq", "vector")


@query(_SEQ + ", p AS (SELECT seq, pos, coalesce(avg(x) FILTER (m), avg(x)) AS x FROM u GROUP BY seq, pos), n AS (SELECT seq, list(x ORDER BY pos) AS v FROM p GROUP BY seq) SELECT a.seq AS row_id, b.seq AS col_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS similarity FROM n a JOIN n b ON true")
def pool_normalize_compare(spark, d):
    p = models.pooled(sequences(spark, d), "tokens", "mean", "mask")
    return rounded(search.similarity_matrix(p, normalized=True, id_col="seq", vector_col="vector"), "similarity")


_DIM = "unnest(range(1, len(embedding) + 1)) AS t(i)"


@query(f"SELECT label, (i - 1)::INT AS pos, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, {_DIM} GROUP BY label, pos")
def label_centroids(spark, d):
    return exploded(chunking.aggregate(vectors(spark, d), "mean", "label", "embedding", "vec_id", normalize=False), "label", "vector")


@query(f"WITH m AS (SELECT label, i, sum(embedding[i]::DOUBLE * (1 + vec_id % 7)) / sum(1 + vec_id % 7) AS x FROM embeddings, {_DIM} GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT label, (i - 1)::INT AS pos, round(x / n, 6) AS value FROM m JOIN n USING (label)")
def weighted_mean_pool(spark, d):
    e = vectors(spark, d).withColumn("w", 1 + F.col("vec_id") % 7)
    return exploded(chunking.aggregate(e, "weighted", "label", "embedding", "vec_id", "w"), "label", "vector")


@query(f"SELECT label, 'first' AS which, (i - 1)::INT AS pos, round(arg_min(embedding[i], vec_id)::DOUBLE, 6) AS value FROM embeddings, {_DIM} GROUP BY label, pos UNION ALL SELECT label, 'last', (i - 1)::INT AS pos, round(arg_max(embedding[i], vec_id)::DOUBLE, 6) FROM embeddings, {_DIM} GROUP BY label, pos")
def first_last_pool(spark, d):
    parts = [exploded(chunking.aggregate(vectors(spark, d), w, "label", "embedding", "vec_id", normalize=False), "label", "vector").withColumn("which", F.lit(w)) for w in ("first", "last")]
    return parts[0].unionByName(parts[1]).select("label", "which", "pos", "value")


@query(f"WITH c AS (SELECT vec_id // 8 AS seq, list(embedding ORDER BY vec_id) AS l FROM embeddings GROUP BY seq), f AS (SELECT seq, flatten(l) AS v FROM c) SELECT seq, (i - 1)::INT AS pos, round(v[i]::DOUBLE, 6) AS value FROM f, unnest(range(1, len(v) + 1)) AS t(i)")
def concatenate_pool(spark, d):
    e = vectors(spark, d).withColumn("seq", F.expr("vec_id div 8"))
    return exploded(chunking.aggregate(e, "concatenate", "seq", "embedding", "vec_id", normalize=False), "seq", "vector")


# Reranking


def reranked(spark: SparkSession, d: str, strategy: rerank.Strategy, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    e = vectors(spark, d)
    c = rerank.candidates(search.knn(e, asked(e), 10 * rerank.MULTIPLIER["default"], metric), e)
    return rounded(rerank.rerank(c, asked(e), 10, strategy).drop("embedding"), "distance", "similarity")


_CAND = f"WITH {knn_sql(Metric.EUCLIDEAN, 30)}, c AS (SELECT r.*, exp(-sqrt(d)) AS sim, 1 - ({distance_sql(Metric.COSINE, 'q.embedding', 's.embedding')}) AS cos FROM r JOIN embeddings q ON q.vec_id = query_id JOIN embeddings s ON s.vec_id = id)"


@query(_CAND + " SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, rank)::INT AS rank, id, round(1 - cos, 6) AS distance, round(cos, 6) AS similarity FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, c.rank) <= 10")
def rerank_exact(spark, d):
    return reranked(spark, d, rerank.exact())


@query(_CAND + " SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank, id, round(d, 6) AS distance, round(sim, 6) AS similarity FROM c WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c.rank) <= 10")
def rerank_threshold(spark, d):
    return reranked(spark, d, rerank.threshold(0.3))


@query(_CAND + ", t AS (SELECT * FROM c WHERE sim >= 0.3) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, rank)::INT AS rank, id, round(1 - cos, 6) AS distance, round(cos, 6) AS similarity FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, t.rank) <= 10")
def rerank_composite(spark, d):
    return reranked(spark, d, rerank.composite(rerank.threshold(0.3), rerank.exact()))


@query(_CAND + " SELECT query_id, rank, id, round(d, 6) AS distance, round(sim, 6) AS similarity FROM c WHERE rank <= 10")
def rerank_none(spark, d):
    return reranked(spark, d, rerank.none())


@query()
def rerank_mmr(spark, d):
    return reranked(spark, d, rerank.diversity(0.5), Metric.COSINE)


# Quantization

_I8 = "WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings), s AS (SELECT *, CASE WHEN m > 0 THEN m / {q} ELSE 1 END AS s FROM m), q AS (SELECT vec_id, embedding, s, list_transform(embedding, lambda x: greatest(-{q}, least({q}, round(x::DOUBLE / s)))::INT) AS c FROM s)"


@query(_I8.format(q=127) + " SELECT vec_id, round(s, 6) AS scale, (i - 1)::INT AS pos, c[i] AS code FROM q, unnest(range(1, len(c) + 1)) AS t(i)")
def quantize_int8(spark, d):
    return vectors(spark, d).withColumn("q", V.int8("embedding")).select("vec_id", r6("q.scale").alias("scale"), F.posexplode("q.codes").alias("pos", "code"))


_BACK = ", b AS (SELECT vec_id, embedding, list_transform(c, lambda x: x * s) AS w FROM q), e AS (SELECT vec_id, list_transform(range(1, len(w) + 1), lambda i: embedding[i]::DOUBLE - w[i]) AS e, list_dot_product(embedding::DOUBLE[], w) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(w, w))) AS c FROM b) SELECT vec_id, round(list_max(list_transform(e, lambda x: abs(x))), 6) AS max_abs, round(list_avg(list_transform(e, lambda x: abs(x))), 6) AS mean_abs, round(sqrt(list_avg(list_transform(e, lambda x: x * x))), 6) AS rmse, round(c, 6) AS cosine FROM e"


def errors_of(df: DataFrame, back) -> DataFrame:
    return rounded(df.withColumn("e", V.quantization_error("embedding", back)).select("vec_id", "e.*"), "max_abs", "mean_abs", "rmse", "cosine")


@query(_I8.format(q=127) + _BACK)
def dequantize_error_int8(spark, d):
    e = vectors(spark, d).withColumn("q", V.int8("embedding"))
    return errors_of(e, V.dequantized(F.col("q.codes"), F.col("q.scale")))


@query(_I8.format(q=7) + _BACK)
def quantize_int4(spark, d):
    e = vectors(spark, d).withColumn("q", V.int4("embedding")).withColumn("packed", V.packed_nibbles(F.col("q.codes")))
    return errors_of(e, V.dequantized(V.unpacked_nibbles(F.col("packed"), F.size("embedding")), F.col("q.scale"), zero=8))


@query("SELECT vec_id, format, bytes::BIGINT AS bytes, round(4 * len(embedding) / bytes, 6) AS ratio FROM (SELECT vec_id, embedding, unnest(['float32', 'float16', 'int8', 'int4', 'binary']) AS format, unnest([4 * len(embedding), 2 * len(embedding), 4 + len(embedding), 4 + (len(embedding) + 1) // 2, (len(embedding) + 7) // 8]) AS bytes FROM embeddings)")
def quantization_sizes(spark, d):
    e = vectors(spark, d).select("vec_id", F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(f), V.stored_bytes(F.size("embedding"), f)) for f in V.FORMATS]))).alias("format", "bytes"), F.size("embedding").alias("n"))
    return e.select("vec_id", "format", "bytes", r6(4 * F.col("n") / F.col("bytes")).alias("ratio"))


@query("SELECT format, bytes::DOUBLE AS bytes, round(32.0 / bits, 6) AS ratio, round(sum(len(embedding) * bits) / 8, 6) AS total FROM embeddings, (VALUES ('float32', 32, 4.0), ('float16', 16, 2.0), ('int8', 8, 1.0), ('int4', 4, 0.5), ('binary', 1, 0.125)) f(format, bits, bytes) GROUP BY format, bits, bytes")
def quantization_ratios(spark, d):
    """Bytes an element, compression over 32-bit floats and bytes of all elements, by format."""
    n = vectors(spark, d).agg(F.sum(F.size("embedding")).alias("n"))
    forms = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.lit(V.bytes_per_element(f)).alias("bytes"), F.lit(V.compression_ratio(f)).alias("ratio")) for f in V.FORMATS])).alias("f")
    return n.select("n", forms).select("f.*", (F.col("n") * F.col("f.bytes")).alias("total"))


@query("WITH t AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: (x::DECIMAL(18,12) * x::DECIMAL(18,12))))::DOUBLE) AS n, list_sum(list_transform(embedding, lambda x: x::DECIMAL(38,15)))::DOUBLE AS s FROM embeddings) SELECT vec_id, round(s, 6) AS total, round(embedding[1] / n, 6) AS large, round(embedding[1] / n, 6) AS small, round(n, 6) AS norm FROM t")
def normalize_stable(spark, d):
    """Sums with 1e20 and -1e20 around the elements, and unit vectors of 1e200 and 1e-200 times the elements."""
    e = vectors(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    around = F.concat(F.array(F.lit(1e20)), "e", F.array(F.lit(-1e20)))
    times = lambda k: F.get(V.normalize_stable(F.transform("e", lambda x: x * k)), F.lit(0))
    return e.select("vec_id", r6(V.stable_total(around)).alias("total"), r6(times(1e200)).alias("large"), r6(times(1e-200)).alias("small"), r6(V.stable_norm("e")).alias("norm"))


@query()
def quantize_float16(spark, d):
    return errors_of(vectors(spark, d), F.transform(files.float16("embedding"), lambda x: x.cast("double")))


_BITS = "WITH w AS (SELECT vec_id, list_transform(range(0, (len(embedding) + 31) // 32), lambda w: list_sum(list_transform(range(0, 32), lambda k: CASE WHEN coalesce(embedding[w * 32 + k + 1], 0) > 0 THEN (1::BIGINT << k::INT) ELSE 0 END))::BIGINT) AS b FROM embeddings)"


@query(_BITS + " SELECT vec_id, (i - 1)::INT AS pos, b[i] AS word FROM w, unnest(range(1, len(b) + 1)) AS t(i)")
def quantize_binary(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(V.binary("embedding")).alias("pos", "word"))


@query(_BITS + ", p AS (SELECT q.vec_id AS query_id, s.vec_id AS id, list_sum(list_transform(range(1, len(q.b) + 1), lambda i: bit_count(xor(q.b[i], s.b[i]))))::INT AS hamming FROM w q JOIN w s ON q.vec_id <> s.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY hamming, id)::INT AS rank, id, hamming FROM p QUALIFY rank <= 10")
def hamming_topk(spark, d):
    """Bits as vectors of 0 and 1 in the search by blocks: their Manhattan distance is the Hamming distance."""
    b = vectors(spark, d).select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("double")).alias("embedding"))
    hits = search.knn(b, asked(b), 10, Metric.MANHATTAN, skip_self=True)
    return hits.select("query_id", "rank", "id", F.col("distance").cast("int").alias("hamming"))


# IVF: the centroids are the sixteen vectors of least id.

_CELLS = f"WITH c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, embedding AS e FROM embeddings ORDER BY vec_id LIMIT 16), n AS (SELECT vec_id, embedding, cell, {distance_sql(Metric.EUCLIDEAN, 'embedding', 'e')} AS d FROM embeddings, c), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cell) AS k FROM n)"


def first_vectors(e: DataFrame, n: int) -> np.ndarray:
    return np.array([r[0] for r in e.orderBy("vec_id").limit(n).select("embedding").collect()], float)


@query(_CELLS + " SELECT vec_id, cell::INT AS cell FROM o WHERE k = 1")
def ivf_assign(spark, d):
    e = vectors(spark, d)
    return search.ivf_assign(e, first_vectors(e, 16)).select(F.col("id").alias("vec_id"), "cell")


#: Of sixteen cells: with vectors without clusters, as here, fewer lose neighbours (recall at 10: 0.5 with 4, over 0.9 from 12 on).
PROBES = 13
_IVF = _CELLS + f", h AS (SELECT q.vec_id AS query_id, s.vec_id AS id, {distance_sql(Metric.EUCLIDEAN, 'q.embedding', 's.embedding')} AS d FROM o q JOIN o s ON q.cell = s.cell AND s.k = 1 WHERE q.k <= {PROBES} AND q.vec_id % 50 = 0), f AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INT AS rank, id, d FROM h QUALIFY rank <= 10)"


def probed(e: DataFrame, probes: int = PROBES) -> DataFrame:
    c = first_vectors(e, 16)
    return search.ivf_search(search.ivf_assign(e, c), asked(e), c, probes, 10)


@query(_IVF + " SELECT query_id, rank, id, round(d, 6) AS distance FROM f")
def ivf_search(spark, d):
    return rounded(probed(vectors(spark, d)), "distance").drop("similarity")


@query(_IVF + f", {knn_sql(Metric.EUCLIDEAN, 10)} SELECT r.query_id, round(count(f.id) / count(*), 6) AS recall FROM r LEFT JOIN f ON f.query_id = r.query_id AND f.id = r.id GROUP BY r.query_id")
def ivf_recall(spark, d):
    e = vectors(spark, d)
    return rounded(search.recall(probed(e), search.knn(e, asked(e), 10, Metric.EUCLIDEAN)), "recall")


@query()
def ivf_trained(spark, d):
    e = vectors(spark, d)
    c = search.train_centroids(e, 16, rounds=5)
    return search.ivf_search(search.ivf_assign(e, c), asked(e), c, PROBES, 10)


# Graph and projection


@query(f"WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt({distance_sql(Metric.EUCLIDEAN, 'a.embedding', 'b.embedding')}) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS k FROM p QUALIFY k <= 10), s AS (SELECT *, greatest(1e-6, max(CASE WHEN k = 6 THEN d END) OVER (PARTITION BY src)) AS sigma FROM r) SELECT src, dst, round(d, 6) AS distance, round(exp(-d / sigma), 6) AS weight FROM s")
def knn_graph(spark, d):
    return rounded(graph.knn_graph(vectors(spark, d), 10), "distance", "weight")


@query("SELECT count(*) AS vectors, 10 * count(*) AS edges, true AS recalled FROM embeddings")
def knn_graph_descent(spark, d):
    """The graph by descent over neighbours of neighbours, and whether it has 0.95 or more of the exact one's edges."""
    e = vectors(spark, d)
    found = written(graph.descended(e, 10).select("src", "dst"))
    shared = F.count_if("hit").alias("shared")
    both = found.join(graph.knn_graph(e, 10).select("src", "dst", F.lit(True).alias("hit")), ["src", "dst"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return both.agg(F.count_distinct("src").alias("vectors"), F.count("*").alias("edges"), shared).select("vectors", "edges", (F.col("shared") >= 0.95 * F.col("edges")).alias("recalled"))


@query()
def umap_2d(spark, d):
    return graph.project(vectors(spark, d), ProjectionConfig(neighbours=10, iterations=50))


# Text


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_P = r""",.!?;:"''()\[\]{}"""
_SIMPLE = rf"regexp_extract_all(text, '[{_P}]|[^\s{_P}]+')"
_BASIC = r"regexp_extract_all(lower(text), '[\p{P}\p{S}]|[^\s\p{P}\p{S}]+')"


@query(f"SELECT doc_id, len({_SIMPLE})::INT AS n_tokens, sha256(array_to_string({_SIMPLE}, chr(10))) AS tokens FROM documents")
def tokenize_simple(spark, d):
    return docs(spark, d).withColumn("t", T.simple_tokens("text")).select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", "\n"), 256).alias("tokens"))


@query(f"WITH t AS (SELECT unnest({_SIMPLE}) AS token FROM documents), c AS (SELECT token, count(*) AS n, hex(encode(token)) AS h FROM t GROUP BY token) SELECT token, n, (list_reduce(list_transform(range(0, len(h) // 2), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)::HUGEINT[], lambda a, b: (a * 33 + b) % 18446744073709551616::HUGEINT, 5381::HUGEINT) % 100000)::BIGINT AS id FROM c")
def simple_token_ids(spark, d):
    """Each distinct token is hashed once."""
    t = docs(spark, d).select(F.explode(T.simple_tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.select("token", "n", T.djb2_id("token").alias("id"))


@query(f"SELECT doc_id, len({_BASIC})::INT AS n_tokens, sha256(array_to_string({_BASIC}, chr(10))) AS tokens FROM documents")
def basic_tokenize(spark, d):
    return docs(spark, d).withColumn("t", T.basic_tokens("text")).select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", "\n"), 256).alias("tokens"))


@query(f"WITH t AS (SELECT lang, unnest({_BASIC}) AS token FROM documents) SELECT lang, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM t GROUP BY lang")
def token_counts(spark, d):
    """Tokens are counted by language and token first, so a language with most rows is spread."""
    t = docs(spark, d).select("lang", F.explode(T.basic_tokens("text")).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    return t.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"))


@query(f"WITH t AS (SELECT doc_id, {_SIMPLE} AS t FROM documents), c AS (SELECT doc_id, CASE WHEN len(t) > 16 THEN t[1:8] || t[len(t) - 7:] ELSE t END AS m, CASE WHEN len(t) > 16 THEN t[len(t) - 15:] ELSE t END AS s, t[1:16] AS e FROM t) SELECT doc_id, array_to_string(m, ' ') AS middle, array_to_string(s, ' ') AS start, array_to_string(e, ' ') AS \"end\" FROM c")
def truncate_tokens(spark, d):
    t = docs(spark, d).withColumn("t", T.simple_tokens("text"))
    return t.select("doc_id", *[F.array_join(T.truncate("t", 16, how), " ").alias(how) for how in ("middle", "start", "end")])


@query(f"WITH t AS (SELECT doc_id, list_transform({_SIMPLE}[1:32], lambda x: len(x)::INT) AS i FROM documents) SELECT doc_id, array_to_string(list_resize(i, 32, 0), ',') AS ids, least(len(i), 32)::INT AS kept FROM t")
def pad_max(spark, d):
    """Token lengths stand for ids."""
    t = docs(spark, d).select("doc_id", F.transform(T.truncate(T.simple_tokens("text"), 32), lambda x: F.length(x)).alias("i"))
    p = t.withColumn("p", T.pad("i", 32))
    return p.select("doc_id", F.array_join(F.transform("p.ids", lambda x: x.cast("string")), ",").alias("ids"), F.aggregate("p.mask", F.lit(0), lambda s, x: s + x).alias("kept"))


_HASH = r"sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"


@query(f"SELECT doc_id, {_HASH} AS text_hash FROM documents")
def text_hash(spark, d):
    return docs(spark, d).select("doc_id", T.text_hash("text").alias("text_hash"))


@query(f"SELECT {_HASH} AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text_hash HAVING count(*) > 1")
def exact_duplicates(spark, d):
    h = docs(spark, d).select(T.text_hash("text").alias("text_hash"), "doc_id")
    return h.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def windowed_sql(parts: str, count: int, keep: int, sep: str, least: int) -> str:
    stride = count - keep
    return f"""p AS (SELECT doc_id, text, {parts} AS p FROM documents WHERE text <> ''),
f AS (SELECT doc_id, text, p, CASE WHEN len(p) >= {count} THEN (len(p) - {count}) // {stride} + 1 ELSE 0 END AS f FROM p),
w AS (SELECT doc_id, text, len(p) AS n, f, list_transform(range(0, f), lambda i: array_to_string(p[i * {stride} + 1:i * {stride} + {count}], {sep})) AS c, array_to_string(p[f * {stride} + 1:], {sep}) AS r FROM f),
c AS (SELECT doc_id, CASE WHEN n = 0 THEN [text] WHEN r = '' THEN c WHEN len(r) >= {least} OR f = 0 THEN c || [r] ELSE c[1:f - 1] || [c[f] || {sep} || r] END AS c FROM w)
SELECT doc_id, (i - 1)::INT AS pos, sha256(c[i]) AS chunk FROM c, unnest(range(1, len(c) + 1)) AS t(i)"""


def hashed_chunks(df: DataFrame, chunks) -> DataFrame:
    return df.select("doc_id", F.posexplode(chunks).alias("pos", "chunk")).withColumn("chunk", F.sha2("chunk", 256))


@query("WITH " + windowed_sql("list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+'), lambda s: trim(s)), lambda s: s <> '')", 5, 1, "' '", 20))
def chunk_sentences(spark, d):
    return hashed_chunks(docs(spark, d), T.chunk_sentences("text", 5, 50, 20))


@query("WITH " + windowed_sql(r"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')", 3, 1, "chr(10) || chr(10)", 20))
def chunk_paragraphs(spark, d):
    return hashed_chunks(docs(spark, d), T.chunk_paragraphs("text", 3, 50, 20))


@query()
def chunk_characters(spark, d):
    return chunking.chunk(docs(spark, d), chunking.SHORT)


@query(f"WITH t AS (SELECT doc_id, {_SIMPLE} AS t FROM documents), n AS (SELECT doc_id, t, CASE WHEN len(t) <= 64 THEN 1 ELSE (len(t) - 64 + 47) // 48 + 1 END AS n FROM t WHERE len(t) > 0) SELECT doc_id, (i - 1)::INT AS index, n::INT AS total, len(t[(i - 1) * 48 + 1:(i - 1) * 48 + 64])::INT AS n_tokens, sha256(array_to_string(t[(i - 1) * 48 + 1:(i - 1) * 48 + 64], '')) AS text FROM n, unnest(range(1, n + 1)) AS u(i)")
def chunk_tokens(spark, d):
    t = docs(spark, d).select("doc_id", T.simple_tokens("text").alias("tokens"))
    c = chunking.chunk_tokens(t, 64, 16)
    return c.select("doc_id", "index", "total", "n_tokens", F.sha2("text", 256).alias("text"))


@query()
def chunk_aggregate_weighted(spark, d):
    return chunking.embed_documents(docs(spark, d), chunking.SENTENCES, models.HashEmbedder(64), "weighted")


SPECIAL = {"pad": "[PAD]", "cls": "[CLS]", "sep": "[SEP]", "unk": "[UNK]", "mask": "[MASK]"}


def learned(spark: SparkSession, d: str) -> dict[str, int]:
    return tokenizers.learned_vocabulary(docs(spark, d), 2000, list(SPECIAL.values()))


def token_digests(encoded: DataFrame) -> DataFrame:
    joined = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), "\n"), 256)
    return encoded.select("doc_id", F.size("tokens").alias("n_tokens"), joined("ids").alias("ids"), joined("tokens").alias("tokens"))


#: The vocabulary in SQL: special tokens, words by frequency, letters, marked letters, the boundary mark and marked words; the first place of a token counts.
_VOCABULARY = f"""a AS (SELECT unnest({_BASIC}) AS t FROM documents), top AS (SELECT t, row_number() OVER (ORDER BY count(*) DESC, t) AS k FROM a GROUP BY t ORDER BY k LIMIT 2000),
letters AS (SELECT DISTINCT unnest(string_split(t, '')) AS c FROM top), placed AS (SELECT '[PAD]' AS t, 0 AS part, 0 AS k UNION ALL SELECT '[CLS]', 0, 1 UNION ALL SELECT '[SEP]', 0, 2 UNION ALL SELECT '[UNK]', 0, 3 UNION ALL SELECT '[MASK]', 0, 4
UNION ALL SELECT t, 1, k FROM top UNION ALL SELECT c, 2, row_number() OVER (ORDER BY c) FROM letters UNION ALL SELECT '##' || c, 3, row_number() OVER (ORDER BY c) FROM letters UNION ALL SELECT '{tokenizers.SPACE_MARK}', 4, 0 UNION ALL SELECT '{tokenizers.SPACE_MARK}' || t, 5, k FROM top),
v AS (SELECT t, row_number() OVER (ORDER BY min((part, k))) - 1 AS id FROM placed GROUP BY t), deep AS (SELECT max(length(t)) AS n FROM v)"""
#: Greedy splits of the distinct words w of d: a row for each step, with the tokens so far.
_GREEDY = """steps AS (SELECT w, 0 AS pos, []::VARCHAR[] AS toks, false AS bad FROM d UNION ALL
SELECT s.w, s.pos + greatest(1, coalesce(max(CASE WHEN v.t IS NOT NULL THEN l END), 0)), list_append(s.toks, coalesce(arg_max({mark} || substr(s.w, s.pos + 1, l), l) FILTER (v.t IS NOT NULL), '[UNK]')), s.bad OR max(CASE WHEN v.t IS NOT NULL THEN l END) IS NULL
FROM (SELECT *, unnest(range(1, least(length(w) - pos, (SELECT n FROM deep)) + 1)) AS l FROM steps WHERE pos < length(w)) s LEFT JOIN v ON v.t = {mark} || substr(s.w, s.pos + 1, l) GROUP BY s.w, s.pos, s.toks, s.bad)"""
_ENCODED = """o AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM x), e AS (SELECT doc_id, flatten(list(toks ORDER BY pos)) AS toks FROM o JOIN f USING (w) GROUP BY doc_id),
g AS (SELECT x.doc_id, list_concat(['[CLS]'], coalesce(toks, []), ['[SEP]']) AS toks FROM x LEFT JOIN e USING (doc_id)), i AS (SELECT doc_id, list(v.id ORDER BY pos) AS ids FROM (SELECT doc_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM g) u JOIN v USING (t) GROUP BY doc_id)
SELECT g.doc_id, len(toks)::INT AS n_tokens, sha256(array_to_string(ids, chr(10))) AS ids, sha256(array_to_string(toks, chr(10))) AS tokens FROM g JOIN i USING (doc_id)"""


@query(f"WITH RECURSIVE {_VOCABULARY}, x AS (SELECT doc_id, {_BASIC} AS words FROM documents), d AS (SELECT DISTINCT unnest(words) AS w FROM x), " + _GREEDY.format(mark="(CASE WHEN s.pos > 0 THEN '##' ELSE '' END)") + ", f AS (SELECT w, CASE WHEN bad OR length(w) > 200 THEN ['[UNK]'] ELSE toks END AS toks FROM steps WHERE pos >= length(w)), " + _ENCODED)
def wordpiece_encode(spark, d):
    """Whole texts: digests of ids and tokens."""
    return token_digests(tokenizers.encode(docs(spark, d), tokenizers.WordPiece(learned(spark, d), SPECIAL), tokenizers.Options(max_length=0)))


@query(f"WITH RECURSIVE {_VOCABULARY}, x AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '\S+'), lambda w: '{tokenizers.SPACE_MARK}' || w) AS words FROM documents), d AS (SELECT DISTINCT unnest(words) AS w FROM x), " + _GREEDY.format(mark="''") + ", f AS (SELECT w, toks FROM steps WHERE pos >= length(w)), " + _ENCODED)
def sentencepiece_encode(spark, d):
    return token_digests(tokenizers.encode(docs(spark, d), tokenizers.SentencePiece(learned(spark, d), SPECIAL), tokenizers.Options(max_length=0)))


def public_bpe(spark: SparkSession) -> tokenizers.ByteBPE:
    """The byte-level tokenizer of 50,257 tokens."""
    import public_tokenizers

    return replace(files.tokenizer_file(spark, "file://" + public_tokenizers.path("byte_bpe_50k.json")), pattern=public_tokenizers.PATTERN)


@query()
def bpe_encode(spark, d):
    """Whole texts by a public vocabulary; tests hold its ids against those of the library that it was made for."""
    return token_digests(tokenizers.encode(docs(spark, d), public_bpe(spark), tokenizers.Options(max_length=0, special_tokens=False)))


_IDS = f"SELECT doc_id, list_transform({_SIMPLE}, lambda t: (ascii(t) * 64 + length(t)) % 30000) AS ids FROM documents"
_ELEMENTS = ", ".join(f"avg((id * {j + 1} + pos) % 1000)::DOUBLE / 1000 AS m{j}" for j in range(8))
_LENGTH = "sqrt(" + " + ".join(f"m{j} * m{j}" for j in range(8)) + ")"


@query(f"""WITH i AS ({_IDS}), t AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM i), m AS (SELECT doc_id, {_ELEMENTS} FROM t GROUP BY doc_id)
SELECT i.doc_id, len(ids)::INT AS tokens, (greatest(1, ceil(len(ids) / 16.0)) * 16)::INT AS padded, {", ".join(f"coalesce(round(m{j} / {_LENGTH}, 6), 0) AS v{j}" for j in range(8))} FROM i LEFT JOIN m USING (doc_id)""")
def model_run(spark, d):
    """Whole texts through a model of token matrices: ids, micro-batches by length, pooling, normalization."""
    ids = F.transform(T.simple_tokens("text"), lambda t: (F.ascii(t) * 64 + F.length(t)) % 30000)
    run = models.run_model(docs(spark, d).select("doc_id", ids.alias("ids")), models.ModularModel(8), config=EmbeddingConfig(2**31 - 1), batches=BatchConfig(max_tokens=16_384))
    return run.select("doc_id", "tokens", "padded", *[F.round(F.col("vector")[j], 6).alias(f"v{j}") for j in range(8)])


@query(f"WITH i AS ({_IDS}), p AS (SELECT least(len(ids), 512) AS n, (greatest(1, ceil(least(len(ids), 512) / 16.0)) * 16)::INT AS padded FROM i) SELECT padded, count(*) AS rows, sum(n)::BIGINT AS tokens, sum(padded - n)::BIGINT AS padding, round(sum(padded - n) / sum(padded), 6) AS share FROM p GROUP BY padded")
def model_padding(spark, d):
    """How much of what a model of 512 tokens at most runs over is padding, by padded length."""
    ids = F.transform(T.simple_tokens("text"), lambda t: (F.ascii(t) * 64 + F.length(t)) % 30000)
    run = models.run_model(docs(spark, d).select("doc_id", ids.alias("ids")), models.ModularModel(8))
    return rounded(models.padding_shares(run), "share")


@query()
def hash_embed(spark, d):
    return models.embed(docs(spark, d), models.HashEmbedder(64))


#: Names of model families, from which ids are made with the sources and languages of the documents.
_FAMILIES = ("MiniLM-L6", "distilbert", "all-mpnet-base", "roberta", "bert-large", "e5", "x-gte", "plain")
_IDS_SQL = f"i AS (SELECT DISTINCT coalesce(source, 'none') || '/' || {list(_FAMILIES)}[doc_id % 8 + 1] || CASE WHEN n_chars % 3 > 0 THEN '-' || lang ELSE '' END || '@' || n_chars % 10 AS id FROM documents)"


def model_ids(spark: SparkSession, d: str) -> DataFrame:
    family = F.get(F.array(*map(F.lit, _FAMILIES)), (F.col("doc_id") % 8).cast("int"))
    variant = F.when(F.col("n_chars") % 3 > 0, F.concat(F.lit("-"), "lang")).otherwise(F.lit(""))
    return docs(spark, d).select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), family, variant, F.lit("@"), (F.col("n_chars") % 10).cast("string")).alias("id")).distinct()


@query(f"WITH {_IDS_SQL} SELECT id, regexp_extract(id, '^([^/]*)/', 1) AS provider, CASE WHEN contains(f, '-') THEN regexp_extract(f, '^(.*)-[^-]*$', 1) ELSE f END AS name, CASE WHEN contains(f, '-') THEN regexp_extract(f, '-([^-]*)$', 1) END AS variant, regexp_extract(id, '@([^@]*)$', 1) AS version FROM (SELECT id, regexp_extract(id, '^[^/]*/(.*)@[^@]*$', 1) AS f FROM i)")
def model_id_parse(spark, d):
    return model_ids(spark, d).select("id", T.parse_model_id("id").alias("p")).select("id", "p.*")


@query(f"WITH {_IDS_SQL} SELECT id, CASE WHEN regexp_matches(n, 'minilm|mini-lm') THEN 'minilm' WHEN contains(n, 'distilbert') THEN 'distilbert' WHEN contains(n, 'mpnet') THEN 'mpnet' WHEN contains(n, 'roberta') THEN 'roberta' WHEN contains(n, 'bert') THEN 'bert' WHEN regexp_matches(n, '-e5-|^e5-') THEN 'e5' WHEN regexp_matches(n, '-gte-|^gte-') THEN 'gte' END AS family FROM (SELECT id, lower(regexp_extract(id, '^[^/]*/(.*)@', 1)) AS n FROM i)")
def model_family(spark, d):
    return model_ids(spark, d).select("id", files.model_family(F.regexp_extract("id", r"^[^/]*/(.*)@", 1)).alias("family"))


# Cache: all documents are cached, with the vector of their id or else a constant one; the clock of an entry is the event of its id, or else the first of the year.


def cached(spark: SparkSession, d: str) -> DataFrame:
    e = vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding")
    ts = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("accessed"))
    rows = docs(spark, d).join(e, "doc_id", "left").join(ts, "doc_id", "left")
    vector = F.coalesce("embedding", F.array_repeat(F.lit(0.125).cast("float"), 64))
    c = cache.entries(rows.withColumn("vector", vector), F.coalesce("accessed", F.to_timestamp(F.lit("2024-01-01")).cast(ts.schema["accessed"].dataType)), "m")
    return c.groupBy(*cache.KEY).agg(F.max(F.struct("accessed_at", *[x for x in c.columns if x not in ("accessed_at", "text_hash", "model_id")])).alias("r")).select(*cache.KEY, "r.*")


def asked_texts(spark: SparkSession, d: str) -> DataFrame:
    """Requests: the documents' texts, and those of the conversations, with ids below 0."""
    talk = table(spark, d, "conversations").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("id"), "text")
    return docs(spark, d).select(F.col("doc_id").alias("id"), "text").unionByName(talk)


_ENTRIES = f"entries AS (SELECT {_HASH} AS text_hash, text, coalesce(ts, TIMESTAMP '2024-01-01') AS ts, coalesce(embedding, list_transform(range(64), lambda i: 0.125::FLOAT)) AS embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN events ON event_id = doc_id)"
_CACHE = _ENTRIES + ", cache AS (SELECT text_hash, max(ts) AS accessed_at, arg_max(strlen(text) + 4 * len(embedding) + 200, (ts, text)) AS size FROM entries GROUP BY text_hash)"
_REQUESTS = "requests AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations)"


@query(f"WITH {_CACHE}, {_REQUESTS} SELECT id, (c.text_hash IS NOT NULL) AS hit FROM (SELECT id, {_HASH} AS h FROM requests) d LEFT JOIN cache c ON c.text_hash = d.h")
def cache_lookup_exact(spark, d):
    return cache.lookup(cached(spark, d), asked_texts(spark, d), "m").select("id", "hit")


@query(f"WITH {_ENTRIES}, cv AS (SELECT text_hash, max(ts) AS accessed_at, arg_max(embedding, (ts, text, embedding)) AS v FROM entries GROUP BY text_hash), t AS (SELECT * FROM cv ORDER BY accessed_at DESC, text_hash LIMIT 1000), s AS (SELECT vec_id, text_hash, accessed_at, 1 - ({distance_sql(Metric.COSINE, 'embedding', 'v')}) AS s FROM embeddings, t WHERE vec_id % 50 = 0) SELECT vec_id, round(max(s), 6) AS similarity FROM s WHERE s >= 0.3 GROUP BY vec_id")
def cache_semantic_match(spark, d):
    e = vectors(spark, d)
    return rounded(cache.lookup_semantic(cached(spark, d), asked(e), "m", 0.3, id_col="vec_id", vector_col="embedding"), "similarity").drop("text_hash")


@query(f"WITH {_CACHE}, {_REQUESTS} SELECT text_hash, count(*) AS n FROM (SELECT text_hash FROM cache UNION SELECT {_HASH} FROM requests) GROUP BY text_hash")
def cache_insert_absent(spark, d):
    new = asked_texts(spark, d).withColumn("vector", F.array_repeat(F.lit(0.125).cast("float"), 64))
    both = cache.insert_absent(cached(spark, d), cache.entries(new, F.timestamp_seconds(F.lit(0)), "m"))
    return both.groupBy("text_hash").agg(F.count("*").alias("n"))


@query(f"WITH {_CACHE} SELECT text_hash FROM cache ORDER BY accessed_at, text_hash OFFSET 50")
def cache_lru_evict(spark, d):
    return cache.evict_least_recent(cached(spark, d), 50).select("text_hash")


@query(f"WITH {_CACHE} SELECT text_hash FROM cache WHERE accessed_at >= TIMESTAMP '2024-01-03'")
def cache_ttl_evict(spark, d):
    return cache.evict_expired(cached(spark, d), F.to_timestamp(F.lit("2024-01-03"))).select("text_hash")


@query(f"WITH {_CACHE}, k AS (SELECT *, (row_number() OVER (ORDER BY accessed_at, text_hash) - 1) // 20 AS b FROM cache), l AS (SELECT b, sum(sum(size)) OVER (ORDER BY b DESC) AS l FROM k GROUP BY b) SELECT text_hash FROM k JOIN l USING (b) WHERE l <= 500000")
def cache_size_evict(spark, d):
    return cache.evict_over_size(cached(spark, d), 500_000, block=20).select("text_hash")


@query(f"WITH {_CACHE} SELECT count(*) AS count, coalesce(sum(size), 0)::BIGINT AS bytes FROM cache")
def cache_statistics(spark, d):
    return store.statistics(cached(spark, d))


@query(f"WITH {_CACHE} SELECT text_hash FROM cache WHERE text_hash NOT IN (SELECT {_HASH} FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def cache_remove(spark, d):
    gone = docs(spark, d).join(table(spark, d, "labels").where("toxic = 1"), "doc_id")
    return cache.remove(cached(spark, d), gone, "m").select("text_hash")


@query(f"WITH c AS (SELECT {_HASH} AS text_hash, count(*) AS access_count, count(*) FILTER (turn < 2) AS early FROM (SELECT text, turn FROM conversations WHERE text IS NOT NULL) GROUP BY text_hash) SELECT text_hash, access_count FROM c")
def cache_stream(spark, d):
    """A cache that follows requests in two batches, the texts of conversations before their third turn and the others; the first one comes twice."""
    c = table(spark, d, "conversations").withColumn("at", F.timestamp_seconds(F.col("turn")))
    t = cache.CacheTable(spark, shared_folder(spark, "cache"), models.HashEmbedder(16))
    t.take(c.where("turn < 2"), 0)
    t.take(c.where("turn < 2"), 0)
    t.take(c.where("turn >= 2"), 1)
    return t.rows().select("text_hash", "access_count")


# Store: events are changes to a store of users.


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def store_upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", "ts")
    return store.latest(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT e.vec_id, e.label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id AND l.toxic = 1)")
def store_remove(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return store.remove(vectors(spark, d).select("vec_id", "label"), gone, "vec_id")


@query("SELECT user_id::VARCHAR AS id, arg_max(event_type, event_id) AS text FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def store_replay(spark, d):
    """The log of all events: errors delete their user's row, others put it."""
    ev = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("text"))
    return store.replay(spark.createDataFrame([], "id string, text string"), ev)


@query("SELECT l.doc_id AS vec_id, (e.vec_id IS NOT NULL) AS found FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN embeddings e ON e.vec_id = l.doc_id")
def store_contains(spark, d):
    return store.contains(vectors(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id")


def stored(spark: SparkSession, d: str, config: IndexConfig) -> store.VectorStore:
    """A new store with all vectors but every fifth, in a snapshot."""
    s = store.VectorStore.create(spark, shared_folder(spark, "store"), config)
    e = vectors(spark, d).where("vec_id % 5 <> 4")
    s.append(e.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), F.col("vec_id").alias("seq")))
    s.checkpoint()
    return s


def logged(spark: SparkSession, d: str, s: store.VectorStore) -> None:
    """Three commits behind the snapshot: the other vectors, new labels for every seventh id, and every eleventh id deleted."""
    e = vectors(spark, d).select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), F.col("embedding").alias("vector"), "vec_id", "label")
    labelled = lambda rows, label: rows.select("id", "vector", F.create_map(F.lit("label"), label.cast("string")).alias("metadata"), F.col("vec_id").alias("seq"))
    s.append(labelled(e.where("vec_id % 5 = 4"), F.col("label")))
    s.append(labelled(e.where("vec_id % 7 = 0"), F.col("label") + 100))
    s.delete(e.where("vec_id % 11 = 0").select("id"))


_STORED = "SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 11 <> 0"


@query(f"SELECT lpad(vec_id::VARCHAR, 12, '0') AS id, label::VARCHAR AS label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM ({_STORED})")
def store_recover(spark, d):
    """The rows of a store that is opened anew after a crash: snapshot and log, without a segment whose writer died before its commit."""
    s = stored(spark, d, IndexConfig(64))
    logged(spark, d, s)
    lost = s.rows().limit(10).select(F.lit("delete").alias("op"), *store.NAMES)
    lost.withColumns({"_part": F.lit(0), "_row": F.lit(0).cast("long")}).write.parquet(f"{s.path}/log/segments/{'0' * 32}")
    again = store.VectorStore.load(spark, s.path)
    again.recover(grace=0)
    return again.rows().select("id", F.col("metadata")["label"].alias("label"), F.round(V.total("vector"), 4).alias("total"))


@query(f"WITH s AS ({_STORED}), p AS (SELECT q.vec_id AS query_id, s.vec_id AS id, {distance_sql(Metric.EUCLIDEAN, 'q.embedding', 's.embedding')} AS d FROM embeddings q JOIN s ON true WHERE q.vec_id % 50 = 0), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INT AS rank, id, d FROM p QUALIFY rank <= 10) SELECT query_id, rank, lpad(id::VARCHAR, 12, '0') AS id, round(d, 6) AS distance FROM r")
def store_ivf_search(spark, d):
    """Searches a store kept by cells, with commits behind its snapshot, by cells in reach: exact."""
    s = stored(spark, d, IndexConfig(64, "ivf", lists=16, probes=4))
    s.train(rounds=5)
    logged(spark, d, s)
    q = asked(vectors(spark, d)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return rounded(s.search_many(q, 10), "distance").select("query_id", "rank", "id", "distance")


# Batches

_LEN = f"WITH l AS (SELECT doc_id, len({_SIMPLE}) AS n FROM documents), b AS (SELECT doc_id, n, least(512, ((greatest(1, n) + 15) // 16) * 16) AS k FROM l)"


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.size(T.simple_tokens("text")).alias("n"))


@query(_LEN + " SELECT k::INT AS bucket_key, count(*) AS rows, sum(k - least(n, k))::BIGINT AS padding FROM b GROUP BY k")
def length_buckets(spark, d):
    n = lengths(spark, d).withColumn("bucket_key", batching.bucket_key(F.col("n")))
    return n.groupBy("bucket_key").agg(F.count("*").alias("rows"), F.sum(F.col("bucket_key") - F.least("n", "bucket_key")).cast("long").alias("padding"))


@query(_LEN + " SELECT doc_id, k::INT AS bucket_key, (doc_id % 64)::INT AS shard, ((row_number() OVER (PARTITION BY k, doc_id % 64 ORDER BY n, doc_id) - 1) // least(32, greatest(1, 4096 // k)))::INT AS batch FROM b")
def micro_batches(spark, d):
    b = batching.micro_batches(lengths(spark, d), F.col("n"), "doc_id", max_tokens=4096, shard=F.col("doc_id") % 64)
    return b.select("doc_id", "bucket_key", "shard", "batch")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END DESC, event_id)::INT AS position FROM events")
def priority_batches(spark, d):
    p = F.when(F.col("event_type") == "error", "urgent").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "signup", "normal").otherwise("low")
    e = table(spark, d, "events").withColumn("priority", p)
    return batching.priority_order(e, "priority", "event_id", 32, "user_id").select("event_id", "position")


@query("WITH p AS (SELECT event_id, value / (1 + value) AS p FROM events) SELECT event_id, CASE WHEN p < 0 OR p > 1 THEN 128 WHEN p <= 0.3 THEN 128 WHEN p <= 0.6 THEN 64 WHEN p <= 0.8 THEN 32 ELSE 16 END::INT AS size FROM p")
def batch_size_by_pressure(spark, d):
    return table(spark, d, "events").select("event_id", batching.optimal_batch(F.col("value") / (1 + F.col("value"))).alias("size"))


# Measures

_BOUNDS = "[" + ", ".join(map(str, measures.BOUNDS)) + "]"


@query(f"SELECT event_type, len(list_filter({_BOUNDS}, lambda b: b <= value / 10))::INT AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def latency_histogram(spark, d):
    return measures.histogram(table(spark, d, "events").withColumn("v", F.col("value") / 10), "v", ["event_type"])


@query("WITH g AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, p::DOUBLE AS percentile, v[floor((len(v) - 1) * p / 100)::INT + 1] AS value FROM g, unnest([50.0, 75.0, 90.0, 95.0, 99.0, 99.9]::DOUBLE[]) AS t(p)")
def latency_percentiles(spark, d):
    return measures.percentiles(table(spark, d, "events"), "value", ["event_type"])


@query("SELECT event_type, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_summary(spark, d):
    return rounded(measures.summary(table(spark, d, "events"), "value", ["event_type"]).withColumn("sum", F.round("sum", 4)), "mean")


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events QUALIFY k <= 1024) SELECT event_type, count(*) AS n, round(max(value), 6) AS high FROM l GROUP BY event_type")
def latest_window(spark, d):
    rows = measures.latest(table(spark, d, "events"), ["ts", "event_id"], ["event_type"])
    return rounded(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("high")), "high")


@query("WITH o AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'exact' WHEN 'click' THEN 'semantic' ELSE 'miss' END AS o FROM events) SELECT user_id, count(*) AS lookups, round(count(*) FILTER (o = 'exact') / count(*), 6) AS exact_rate, round(count(*) FILTER (o = 'semantic') / count(*), 6) AS semantic_rate, round(count(*) FILTER (o <> 'miss') / count(*), 6) AS hit_rate FROM o GROUP BY user_id")
def hit_rates(spark, d):
    o = F.when(F.col("event_type") == "view", "exact").when(F.col("event_type") == "click", "semantic").otherwise("miss")
    return rounded(measures.hit_rates(table(spark, d, "events").withColumn("o", o), "o", ["user_id"]), "exact_rate", "semantic_rate", "hit_rate")


@query("WITH a AS (SELECT event_type AS metric, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS c, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS b FROM events GROUP BY event_type) SELECT metric, round(c, 6) AS current, round(b, 6) AS baseline, round(CASE WHEN b <> 0 THEN (c - b) / b ELSE 0 END, 6) AS change, (CASE WHEN b <> 0 THEN (c - b) / b ELSE 0 END > 0.1) AS regressed FROM a WHERE c IS NOT NULL AND b IS NOT NULL")
def regression_report(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "metric")
    day = F.to_timestamp(F.lit("2024-01-16"))
    mean = lambda rows: rows.groupBy("metric").agg(F.avg("value").alias("value"))
    return rounded(measures.regression_report(mean(e.where(F.col("ts") >= day)), mean(e.where(F.col("ts") < day))), "current", "baseline", "change")


@query("SELECT event_type, count(*) AS requests, round(avg(value), 6) AS mean_latency, round(CASE WHEN sum(value) > 0 THEN sum(user_id) / sum(value) ELSE 0 END, 4) AS tokens_per_second FROM events GROUP BY event_type")
def model_throughput(spark, d):
    return rounded(measures.throughput(table(spark, d, "events"), "user_id", "value", ["event_type"]).withColumn("tokens_per_second", F.round("tokens_per_second", 4)), "mean_latency")


@query("WITH t AS (SELECT unnest([50.0, 90.0, 99.0]::DOUBLE[]) AS percentile) SELECT event_type, percentile, count(value) AS n, true AS within FROM events, t GROUP BY ALL")
def latency_sketch(spark, d):
    """Sketches by hour and type, stored and merged: whether each estimate's true rank is within the bound."""
    e = table(spark, d, "events").where("value IS NOT NULL")
    hourly = written(measures.sketches(e, "value", ["event_type"], "ts"))
    found = measures.sketched_percentiles(measures.merged_sketches(hourly, ["event_type"]), ["event_type"], [50.0, 90.0, 99.0])
    below = e.join(F.broadcast(found), "event_type").groupBy("event_type", "percentile", "n", found["value"]).agg(F.count_if(e["value"] < found["value"]).alias("less"), F.count_if(e["value"] <= found["value"]).alias("upto"))
    off = F.greatest(F.col("less") - F.col("n") * F.col("percentile") / 100, F.col("n") * F.col("percentile") / 100 - F.col("upto"), F.lit(0.0))
    return below.select("event_type", "percentile", "n", (off <= 1 + measures.SKETCH_ERROR * F.col("n")).alias("within"))


_SPANS = "WITH s AS (SELECT event_type, epoch_us(ts) AS b, epoch_us(ts) + floor(value * 60000000)::BIGINT AS e FROM events WHERE value >= 0), x AS (SELECT event_type, b AS t, 1 AS d FROM s UNION ALL SELECT event_type, e, -1 FROM s), g AS (SELECT event_type, t, sum(d) AS d FROM x GROUP BY ALL), l AS (SELECT event_type, t, sum(d) OVER (PARTITION BY event_type ORDER BY t) AS level, lead(t) OVER (PARTITION BY event_type ORDER BY t) - t AS lasts FROM g)"


@query(_SPANS + " SELECT event_type, any_value(n) AS spans, max(level)::BIGINT AS peak, round(sum(level * lasts)::DOUBLE / (max(t) - min(t)), 6) AS mean, sum(CASE WHEN level > 0 THEN lasts END)::BIGINT AS busy, max(t) - min(t) AS whole FROM l JOIN (SELECT event_type, count(*) AS n FROM s GROUP BY event_type) USING (event_type) GROUP BY event_type")
def stage_concurrency(spark, d):
    """Events as spans of `value` minutes."""
    e = table(spark, d, "events").where("value >= 0").withColumn("b", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("e", F.col("b") + F.floor(F.col("value") * 60_000_000))
    return rounded(measures.concurrency(e, "b", "e", ["event_type"]), "mean")


@query("SELECT event_type, count(*) AS runs, sum(user_id)::BIGINT AS items, round(sum(value), 4) AS total_seconds, round(avg(value), 6) AS mean_seconds, round(min(value), 6) AS least_seconds, round(max(value), 6) AS most_seconds, round(avg(user_id), 6) AS mean_batch, round(CASE WHEN sum(value) > 0 THEN sum(user_id) / sum(value) ELSE 0 END, 4) AS items_per_second FROM events GROUP BY event_type")
def stage_metrics(spark, d):
    m = measures.stage_metrics(table(spark, d, "events"), "value", "user_id", ["event_type"])
    return rounded(m, "mean_seconds", "least_seconds", "most_seconds", "mean_batch").withColumns({c: F.round(c, 4) for c in ("total_seconds", "items_per_second")})


# Limiters

_EV = "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query("SELECT user_id, event_id, (count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) <= 3) AS allowed FROM events")
def rate_sliding_window(spark, d):
    return limiters.sliding_window(table(spark, d, "events"), 3, 86_400, "user_id", "ts", "event_id")


@query(_EV + ", s AS (SELECT user_id, event_id, k, t, 1.0::DOUBLE AS left_, true AS allowed FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, e.t, CASE WHEN least(2.0::DOUBLE, s.left_ + (e.t - s.t) * (1.0::DOUBLE / 86400)) >= 1 THEN least(2.0::DOUBLE, s.left_ + (e.t - s.t) * (1.0::DOUBLE / 86400)) - 1 ELSE least(2.0::DOUBLE, s.left_ + (e.t - s.t) * (1.0::DOUBLE / 86400)) END, least(2.0::DOUBLE, s.left_ + (e.t - s.t) * (1.0::DOUBLE / 86400)) >= 1 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) SELECT user_id, event_id, allowed FROM s")
def rate_token_bucket(spark, d):
    return limiters.limit(table(spark, d, "events"), limiters.TokenBucket(2, 1 / 86_400), "user_id", "ts", "event_id")


@query(_EV + ", s AS (SELECT user_id, event_id, k, t AS b, 1 AS n FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t - s.b < 259200 THEN s.b ELSE e.t END, CASE WHEN e.t - s.b < 259200 THEN s.n + 1 ELSE 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) SELECT user_id, event_id, (n <= 4) AS allowed FROM s")
def rate_fixed_window(spark, d):
    return limiters.limit(table(spark, d, "events"), limiters.FixedWindow(4, 259_200), "user_id", "ts", "event_id")


_LEAK = "greatest(0, s.lvl - floor((e.t - s.t) / 100000.0)::BIGINT)"


@query(_EV + f", s AS (SELECT user_id, event_id, k, t, 1::BIGINT AS lvl, true AS allowed FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, s.t + floor((e.t - s.t) / 100000.0) * 100000.0, CASE WHEN {_LEAK} < 2 THEN {_LEAK} + 1 ELSE {_LEAK} END, {_LEAK} < 2 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) SELECT user_id, event_id, allowed FROM s")
def rate_leaky_bucket(spark, d):
    return limiters.limit(table(spark, d, "events"), limiters.LeakyBucket(2, 100_000.0), "user_id", "ts", "event_id")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, greatest(0, count(*) - 2) AS denied FROM events GROUP BY 1, 2")
def rate_aligned_window(spark, d):
    w = limiters.aligned_window(table(spark, d, "events"), 2, "1 day", "user_id", "ts")
    return w.select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "requests", "denied")


@query(_EV + ", s AS (SELECT user_id, event_id, k, t, 1.0::DOUBLE AS left_ FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, e.t, CASE WHEN least(2.0::DOUBLE, s.left_ + (e.t - s.t) * (1.0::DOUBLE / 86400)) >= 1 THEN least(2.0::DOUBLE, s.left_ + (e.t - s.t) * (1.0::DOUBLE / 86400)) - 1 ELSE least(2.0::DOUBLE, s.left_ + (e.t - s.t) * (1.0::DOUBLE / 86400)) END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1), f AS (SELECT user_id, arg_max(left_, k) AS l, arg_max(t, k) AS t FROM s GROUP BY user_id), r AS (SELECT user_id, least(2.0::DOUBLE, l + greatest(0, epoch_us(TIMESTAMP '2024-01-30') / 1e6 - t) * (1.0::DOUBLE / 86400)) AS r FROM f) SELECT user_id, round(r, 6) AS remaining, r < 1 AS limited FROM r")
def rate_status(spark, d):
    """Tokens that each user has left at a time."""
    s = limiters.status(table(spark, d, "events"), limiters.TokenBucket(2, 1 / 86_400), "user_id", "ts", "event_id", at="2024-01-30 00:00:00")
    return rounded(s.drop("last"), "remaining")
