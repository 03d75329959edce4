"""Reranking of candidate lists: relations of query_id, rank, id, distance, similarity and embedding, ordered by rank in each query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

COLUMNS = ("query_id", "rank", "id", "distance", "similarity", "embedding")
SCHEMA = "query_id long, rank int, id long, distance double, similarity double, embedding array<double>"
#: Candidates fetched for each result that is wanted.
MULTIPLIER = {"default": 3, "fast": 2, "accurate": 5}
Strategy = Callable[[DataFrame, DataFrame, int], DataFrame]


def candidates(hits: DataFrame, store: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Hits with their vectors; a hit without one keeps null."""
    v = store.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("embedding"))
    return hits.join(v, "id", "left").select(*COLUMNS)


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*COLUMNS)


def none() -> Strategy:
    """The first k as they are."""
    return lambda rows, queries, k: top(rows, k, "rank")


def exact() -> Strategy:
    """By cosine with the query, computed anew; a candidate without vector keeps its similarity."""

    def apply(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        s = F.when(F.col("embedding").isNull(), F.col("similarity")).otherwise(V.cosine("embedding", "_q"))
        new = rows.join(queries, "query_id").withColumn("similarity", s)
        new = new.withColumn("distance", F.when(F.col("embedding").isNull(), F.col("distance")).otherwise(1 - F.col("similarity")))
        return top(new, k, F.desc("similarity"), "rank")

    return apply


def threshold(least: float) -> Strategy:
    """Those at least that similar, in order."""
    return lambda rows, queries, k: top(rows.where(F.col("similarity") >= least), k, "rank")


def diversity(trade: float = 0.5) -> Strategy:
    """Maximal marginal relevance: takes, again and again, the candidate with the largest trade * similarity - (1 - trade) * its largest cosine (0 at
    least) with those taken; the first of equal ones. A query's candidates, k times the multiplier, are one group."""
    lam = min(1.0, max(0.0, trade))

    def choose(group: pa.Table, k: int) -> pa.Table:
        g = group.sort_by("rank")
        rel = g.column("similarity").to_numpy()
        vecs = g.column("embedding").to_pylist()
        dim = max((len(v) for v in vecs if v), default=0)
        x = np.array([v if v and len(v) == dim else [0.0] * dim for v in vecs], float).reshape(len(vecs), dim)
        n = np.sqrt((x * x).sum(1))
        unit = np.where((n > V.TINY)[:, None], x / np.where(n > V.TINY, n, 1)[:, None], 0)
        near, free, order = np.zeros(len(rel)), np.ones(len(rel), bool), []
        for _ in range(min(k, len(rel))):
            s = np.where(free, lam * rel - (1 - lam) * np.maximum(near, 0), -np.inf)
            best = int(np.argmax(s))
            order.append(best)
            free[best] = False
            near = np.maximum(near, unit @ unit[best])
        out = g.take(pa.array(order, pa.int64()))
        return out.set_column(out.schema.get_field_index("rank"), "rank", pa.array(np.arange(1, len(order) + 1, dtype=np.int32)))

    return lambda rows, queries, k: rows.select(*COLUMNS).groupBy("query_id").applyInArrow(lambda g: choose(g, k), SCHEMA)


def composite(*strategies: Strategy) -> Strategy:
    """One after the other; only the last cuts to k. Without any, the candidates stay as they are, uncut."""

    def apply(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        for i, s in enumerate(strategies):
            rows = s(rows, queries, k if i == len(strategies) - 1 else 2**31 - 1)
        return rows

    return apply


def rerank(rows: DataFrame, queries: DataFrame, k: int, strategy: Strategy, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The strategy's first k of each query's candidates. queries: a relation of query ids and vectors."""
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("_q"))
    return strategy(rows, q, max(k, 0))
