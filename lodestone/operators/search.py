"""Nearest-neighbour search: exact (flat), inverted file (IVF), and similarity matrices.

A search is the join of a small relation of queries with a large relation of vectors. Queries whose checked size fits `BROADCAST_BYTES` go to every task as one
matrix; each batch of the store is scored by one matrix product, keeps k rows a query, and a window merges what is left, so only k rows per query and batch are
shuffled. More queries than that are dealt into groups that meet the store in a co-grouped shuffle of blocks. A metadata filter is a Column on the store
and is applied before the top k, where Catalyst pushes it into the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import Metric

BROADCAST_BYTES = 32 << 20
HITS = "query_id long, id long, distance double"


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length, as doubles. Null vectors and other lengths are errors here; see `same_length`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def distances(q: np.ndarray, x: np.ndarray, metric: Metric) -> np.ndarray:
    """Search distances of queries (rows of q) from vectors: euclidean squared, inner product negated."""
    metric = Metric(metric)
    if metric is Metric.DOT:
        return -(q @ x.T)
    if metric is Metric.COSINE:
        a, b = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
        zero = (a <= V.TINY)[:, None] | (b <= V.TINY)[None, :]
        return 1 - np.where(zero, 0, (q @ x.T) / np.where(zero, 1, a[:, None] * b[None, :]))
    out = np.empty((len(q), len(x)))
    for i, row in enumerate(q):
        d = x - row
        out[i] = (d * d).sum(1) if metric is Metric.EUCLIDEAN else np.abs(d).sum(1) if metric is Metric.MANHATTAN else np.abs(d).max(1, initial=0)
    return out


#: Queries and rows whose distances are held at once, about: 16 MB of doubles.
TILE_QUERIES, TILE_ROWS = 256, 8_192


class Nearest:
    """The k nearest rows so far of each query, ties to the smaller id. Rows come in pieces; no more than a tile of their distances is held.

    A tile's distances come from a matrix product where the metric has one; what lies within its error of a query's k-th distance is computed anew pair by pair,
    so that a distance does not depend on the tile and equal vectors tie. far: how far each query's rows may be.
    """

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, metric: Metric | str, k: int, skip_self: bool, far: np.ndarray | None = None):
        self.far = np.full(len(q_ids), np.inf) if far is None else far
        self.metric, self.k, self.skip_self = Metric(metric), k, skip_self
        self.queries = [(q_ids[at : at + TILE_QUERIES], q[at : at + TILE_QUERIES]) for at in range(0, len(q_ids), TILE_QUERIES)]
        self.clear()

    def clear(self) -> None:
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for _ in self.queries]
        self.edges = [self.far[at : at + TILE_QUERIES].astype(float) for at in range(0, len(self.far), TILE_QUERIES)]

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), TILE_ROWS):
            some, v = ids[at : at + TILE_ROWS], x[at : at + TILE_ROWS]
            order, norms = np.argsort(some, kind="stable") if self.skip_self else None, np.sqrt((v * v).sum(1))
            for n in range(len(self.queries)):
                self.meet(n, some, v, order, norms)

    def meet(self, n: int, ids: np.ndarray, x: np.ndarray, order: np.ndarray | None, norms: np.ndarray) -> None:
        (q_ids, q), edge = self.queries[n], self.edges[n]
        d, error = self.about(q, x, norms)
        if order is not None:
            own = [np.searchsorted(ids, q_ids, side, sorter=order) for side in ("left", "right")]
            for i in np.flatnonzero(own[1] > own[0]):
                d[i, order[own[0][i] : own[1][i]]] = np.inf
        limit = edge + error
        if (first := np.flatnonzero(np.isinf(edge))).size and d.shape[1] > self.k:
            some = d[first, : max(96 * self.k, 1024)]  # the k-th of some rows is no nearer than the k-th of all, and enough to rule most of the others out
            limit[first] = np.nan_to_num(np.partition(some, self.k - 1, axis=1)[:, self.k - 1] + 2 * error[first], nan=np.inf, posinf=np.inf, neginf=-np.inf)
        r, c = np.divmod(np.flatnonzero(d <= limit[:, None]), d.shape[1])  # over one axis numpy skips what is False several times faster than over two
        if order is not None:
            other = q_ids[r] != ids[c]
            r, c = r[other], c[other]
        if not len(r):
            return
        exact = self.exact(q, x, r, c) if error.any() else d[r, c]
        if np.isfinite(edge).any():
            near = exact <= edge[r]
            r, c, exact = r[near], c[near], exact[near]
        r, found, exact = (np.concatenate(both) for both in zip(self.found[n], (r, ids[c], exact), strict=True))
        o = np.lexsort((found, exact, r))
        o = o[np.arange(len(r)) - np.searchsorted(r[o], r[o]) < self.k]
        self.found[n] = r, found, exact = r[o], found[o], exact[o]
        last = np.searchsorted(r, np.arange(len(q_ids)), "right")
        full = np.flatnonzero(np.bincount(r, minlength=len(q_ids)) >= self.k)
        edge[full] = exact[last[full] - 1]

    def about(self, q: np.ndarray, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances, and by how much those of a query may be wrong: by nothing where no matrix product can be taken."""
        if self.metric in (Metric.DOT, Metric.COSINE, Metric.EUCLIDEAN):
            with np.errstate(over="ignore", invalid="ignore"):
                a, most = np.sqrt((q * q).sum(1)), norms.max(initial=0.0)
                scale = {Metric.DOT: a * most, Metric.COSINE: 1.0 + 0 * a * most, Metric.EUCLIDEAN: (a + most) ** 2}[self.metric]
            if np.isfinite(scale).all():
                error = 1e-15 * (q.shape[1] + 16) * scale + 1e-300
                if self.metric is Metric.EUCLIDEAN:
                    one = np.ones((max(len(q), len(x)), 1))  # the squares ride along in the product, instead of two more passes over the tile
                    d = np.hstack([q, (a * a)[:, None], one[: len(q)]]) @ np.hstack([-2 * x, one[: len(x)], (norms * norms)[:, None]]).T
                elif self.metric is Metric.COSINE:
                    d = unit_rows(-q, a) @ unit_rows(x, norms).T
                    d += 1
                else:
                    d = -q @ x.T
                return d, error
        return distances(q, x, self.metric), np.zeros(len(q))

    def exact(self, q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The distances of pairs of rows, each by itself."""
        out = np.empty(len(r))
        for at in range(0, len(r), TILE_ROWS):
            a, b = q[r[at : at + TILE_ROWS]], x[c[at : at + TILE_ROWS]]
            if self.metric is Metric.EUCLIDEAN:
                d = ((b - a) ** 2).sum(1)
            else:
                d = -(a * b).sum(1)
                if self.metric is Metric.COSINE:
                    n, m = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
                    zero = (n <= V.TINY) | (m <= V.TINY)
                    d = 1 + np.where(zero, 0, d / np.where(zero, 1, n * m))
            out[at : at + TILE_ROWS] = d
        return out

    def hits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query ids, ids, distances of some queries after the others."""
        for (q_ids, _), (r, ids, d) in zip(self.queries, self.found, strict=True):
            yield q_ids[r], ids, d


def unit_rows(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    held = norms > V.TINY
    return np.where(held[:, None], x / np.where(held, norms, 1)[:, None], 0)


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, metric: Metric, k: int, skip_self: bool, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows for each query (far: none farther than this), ties to the smaller id: query ids, ids, distances."""
    near = Nearest(q_ids, q, metric, k, skip_self, far)
    near.add(ids, x)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *near.hits()]
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def same_length(vectors: DataFrame, vector_col: str, dim: int) -> DataFrame:
    """The rows, failing where a vector has not `dim` elements."""
    return vectors.withColumn(vector_col, F.when(F.size(vector_col) == dim, F.col(vector_col)).otherwise(F.raise_error(F.lit(f"a vector has not {dim} elements")).cast(vectors.schema[vector_col].dataType)))


def knn(store: DataFrame, queries: DataFrame, k: int = 10, metric: Metric | str = Metric.COSINE, where: Column | None = None, skip_self: bool = False, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """query_id, rank, id, distance, similarity: the k nearest vectors of the store for each query (both have id_col and vector_col).

    where: metadata filter on the store, applied first. Euclidean distances are squared. k <= 0 gives no rows; a vector of another length than the
    first query's (or dim) raises; null vectors take no part.
    """
    metric, spark = Metric(metric), store.sparkSession
    if where is not None:
        store = store.where(where)
    store = store.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    queries = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    measured = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    n, dim = measured[0], dim or measured[1] or 0
    if k <= 0 or not n:
        return ranked(spark.createDataFrame([], HITS), max(k, 0), metric)
    store, queries = same_length(store, "v", dim), same_length(queries, "v", dim)
    if n * dim * 8 <= BROADCAST_BYTES:
        rows = queries.collect()  # its size was checked just now
        own = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float).reshape(len(rows), dim)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near, waiting = Nearest(*own.value, metric, k, skip_self), False
            for b in batches:
                near.add(b.column("id").to_numpy(), matrix(b.column("v")))
                waiting = True
                if n * k > HELD_HITS:  # else a task keeps k rows a query over all its batches
                    yield from hit_batches(near)
                    near.clear()
                    waiting = False
            if waiting:
                yield from hit_batches(near)

        return ranked(store.mapInArrow(scan, HITS), k, metric)
    return ranked(blocked(store, queries, parts_of(n, dim), metric, k, skip_self, parts_of(store.count(), dim)), k, metric)


#: Hits that a task holds over all its batches, at most: 48 MB.
HELD_HITS = 1 << 21
#: Vectors of a block that a task holds, about.
BLOCK_ROWS = 65_536


def hit_batches(near: Nearest) -> Iterator[pa.RecordBatch]:
    for got in near.hits():
        if len(got[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "id", "distance"])


def parts_of(n: int, dim: int) -> int:
    """Blocks for n vectors that are compared with as many: of 16 MB of doubles at most, and up to eight, so that more than a few tasks work."""
    return max(1, -(-n * max(dim, 1) * 8 // (16 << 20)), min(8, -(-n // 2048)))


def blocked(store: DataFrame, queries: DataFrame, groups: int, metric: Metric, k: int, skip_self: bool, blocks: int | None = None) -> DataFrame:
    """Hits by query groups meeting blocks of about BLOCK_ROWS vectors of the store in a co-grouped shuffle."""
    blocks = blocks or max(1, -(-store.count() // BLOCK_ROWS))
    q = queries.withColumn("qg", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("sb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    s = store.withColumn("sb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        got = nearest(left.column("id").to_numpy(), matrix(left.column("v")), right.column("id").to_numpy(), matrix(right.column("v")), metric, k, skip_self) if left.num_rows and right.num_rows else empty
        return pa.table(dict(zip(("query_id", "id", "distance"), map(pa.array, got), strict=True)))

    dealt = min(2 * groups * blocks, 2_000)  # as said here Spark deals them, few to a task; else it puts them together by their bytes, which are little beside the work
    q, s = (d.repartition(dealt, "qg", "sb") for d in (q, s))
    return q.groupBy("qg", "sb").cogroup(s.groupBy("qg", "sb")).applyInArrow(meet, HITS)


def ranked(hits: DataFrame, k: int, metric: Metric | None, extra: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    top = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "id", "distance", V.similarity(F.col("distance"), metric).alias("similarity"), *extra)


def search(store: DataFrame, query: list[float], k: int = 10, **how) -> DataFrame:
    """The k nearest vectors for one query: rank, id, distance, similarity."""
    id_col, vector_col = how.get("id_col", "vec_id"), how.get("vector_col", "embedding")
    q = store.sparkSession.createDataFrame([(0, [float(x) for x in query])], f"`{id_col}` long, `{vector_col}` array<double>")
    return knn(store, q, k, **how).drop("query_id")


def min_similarity(hits: DataFrame, threshold: float) -> DataFrame:
    return hits.where(F.col("similarity") >= threshold)


def with_texts(hits: DataFrame, store: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hits whose text is not null, with the text."""
    return hits.join(store.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").where(F.col("text").isNotNull())


def best(hits: DataFrame) -> DataFrame:
    """Each query's most similar hit; the smaller id of equal ones."""
    return hits.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("id")).alias("m"))).alias("b")).select("query_id", (-F.col("b.m")).alias("id"), F.col("b.similarity").alias("similarity"))


def contains_similar(store: DataFrame, queries: DataFrame, threshold: float = 0.9, **how) -> DataFrame:
    """query_id, found: whether the store holds a vector at least that similar."""
    return knn(store, queries, 1, **how).select("query_id", (F.col("similarity") >= threshold).alias("found"))


def find_similar(store: DataFrame, queries: DataFrame, threshold: float = 0.5, limit: int = 100, text_col: str | None = None, **how) -> DataFrame:
    """The nearest `limit`, of which those at least that similar stay; with a text column, also their text, and those without a text go."""
    hits = min_similarity(knn(store, queries, limit, **how), threshold)
    if text_col is None:
        return hits
    texts = store.select(F.col(how.get("id_col", "vec_id")).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return hits.join(texts, "id").select(*hits.columns, "text")


def pairwise(a: DataFrame, b: DataFrame, on: str, vector_col: str = "embedding") -> DataFrame:
    """All five distances of the vectors that two relations hold under one id."""
    x, y = F.col("_a"), F.col("_b")
    joined = a.select(on, F.col(vector_col).alias("_a")).join(b.select(on, F.col(vector_col).alias("_b")), on)
    return joined.select(on, *[V.distance(x, y, m).alias(m.value) for m in Metric])


#: Rows of a similarity matrix that are sent on at once, about.
PIECE = 1 << 17
MATRIX = "row_id long, col_id long, similarity double"


#: Pairs that are put in order of their similarity at once, at most: 256 MB.
ORDERED = 1 << 25


def tile_of(x: np.ndarray, y: np.ndarray, ids: np.ndarray, jds: np.ndarray, metric: Metric, diagonal_one: bool, tile: int) -> np.ndarray:
    """The similarities of at most `tile` rows and any number of columns."""
    s = np.empty((len(ids), len(jds)))
    for c in range(0, len(jds), tile):
        s[:, c : c + tile] = -distances(x, y[c : c + tile], metric)
    s = s + 1 if metric is Metric.COSINE else -np.sqrt(-s) if metric is Metric.EUCLIDEAN else s
    if diagonal_one:
        s[ids[:, None] == jds[None, :]] = 1.0
    return s


def similarities(ids: np.ndarray, x: np.ndarray, jds: np.ndarray, y: np.ndarray, metric: Metric, diagonal_one: bool, tile: int, both: bool = False, digits: int | None = None) -> Iterator[pa.RecordBatch]:
    """row_id, col_id, similarity of all rows against all columns, by matrix products of `tile` rows by `tile` columns; both: also the other way round.

    digits: rounded, halves away from zero, and in order of similarity over up to ORDERED pairs, so that a file holds runs of equal numbers.
    """
    names = ["row_id", "col_id", "similarity"]
    if digits is not None:
        wide = min(len(jds), ORDERED // tile)
        long = max(tile, ORDERED // max(wide, 1) // tile * tile)
        for at in range(0, len(jds), max(wide, 1)):
            for r in range(0, len(ids), long):
                rows, some = ids[r : r + long], jds[at : at + wide]
                for left, right, value in in_order(x[r : r + long], y[at : at + wide], rows, some, metric, diagonal_one, tile, digits, both):
                    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(value)], names=names)
        return
    wide = max(tile, PIECE // tile // tile * tile)
    for at in range(0, len(jds), wide):
        some, own = jds[at : at + wide], y[at : at + wide]
        for r in range(0, len(ids), tile):
            rows = ids[r : r + tile]
            s = tile_of(x[r : r + tile], own, rows, some, metric, diagonal_one, tile)
            for left, right, value in ((rows, some, s), (some, rows, s.T))[: 1 + both]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(left, len(right))), pa.array(np.tile(right, len(left))), pa.array(value.ravel())], names=names)


def in_order(x: np.ndarray, y: np.ndarray, ids: np.ndarray, jds: np.ndarray, metric: Metric, diagonal_one: bool, tile: int, digits: int, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids of rows and columns and their rounded similarity, in order of it, PIECE pairs at a time; both: then the same with rows and columns changed.

    A pair is one number: its similarity in units of the last digit, and its place. What does not fit, as it is very large or not finite, comes after the others.
    """
    low, unit = max(len(jds) - 1, 1).bit_length(), 10.0**digits
    bits = low + max(len(ids) - 1, 1).bit_length()
    most, column = 1 << (62 - bits), np.arange(len(jds))
    keys, rest = np.empty((len(ids), len(jds)), np.int64), []
    for r in range(0, len(ids), tile):
        s = tile_of(x[r : r + tile], y, ids[r : r + tile], jds, metric, diagonal_one, tile)
        with np.errstate(over="ignore", invalid="ignore"):
            k = np.floor(np.abs(s) * unit + 0.5)
        i, j = np.nonzero(~(k < most))
        np.copysign(k, s, out=k)
        if len(i):
            rest.append((i + r, j, np.where(np.isfinite(k[i, j]), k[i, j] / unit, s[i, j])))
            k[i, j] = most  # after all others
        own = keys[r : r + tile]
        own[:] = k
        own <<= bits
        own |= ((np.arange(len(own)) + r) << low)[:, None] | column
    keys = keys.ravel()
    keys.sort()
    whole = len(keys) - sum(len(i) for i, _, _ in rest)
    for turn in range(1 + both):
        for at in range(0, whole, PIECE):
            some = keys[at : min(at + PIECE, whole)]
            pair = ids[(some >> low) & ((1 << (bits - low)) - 1)], jds[some & ((1 << low) - 1)]
            yield *pair[:: -1 if turn else 1], (some >> bits) / unit
        for i, j, value in rest:
            for at in range(0, len(i), PIECE):
                pair = ids[i[at : at + PIECE]], jds[j[at : at + PIECE]]
                yield *pair[:: -1 if turn else 1], value[at : at + PIECE]


def similarity_matrix(rows: DataFrame, columns: DataFrame | None = None, metric: Metric | str = Metric.COSINE, diagonal_one: bool = False, normalized: bool = False, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = 256, digits: int | None = None) -> DataFrame:
    """row_id, col_id, similarity for all rows against all columns (by default themselves), in tiles.

    Each tile is one matrix product of at most `tile` rows and columns. Rows whose checked size fits `BROADCAST_BYTES` go to every task; more of them, and rows against
    themselves, meet the columns in blocks of many tiles, of which a group holds two and sends on a few tiles at a time. normalized: vectors have length 1 and the inner
    product is enough; diagonal_one: the diagonal is 1 even for zero vectors. The similarity is the cosine, the inner product or the negated distance. digits: rounded to so many, and a block's rows in order
    of it: ids of a block and runs of equal similarities take fewer bytes in a Parquet file, the fewer the larger the blocks.
    """
    metric, spark = Metric.DOT if normalized else Metric(metric), rows.sparkSession
    pick = lambda d: d.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    own = columns is None
    a, b = pick(rows), pick(rows if own else columns)
    n, dim = a.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not own and n and n * dim * 8 <= BROADCAST_BYTES:
        got = same_length(a, "v", dim).collect()  # its size was checked just now
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], float).reshape(len(got), dim)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k in batches:
                yield from similarities(*sent.value, k.column("id").to_numpy(), matrix(k.column("v")), metric, diagonal_one, tile, digits=digits)

        return b.repartition(max(1, -(-n * b.count() >> 24)), "id").mapInArrow(scan, MATRIX)
    most = max(1, min(tile * -(-8192 // tile), (16 << 20) // (8 * max(dim, 1))))
    na, nb = (max(1, -(-m // most), min(8, -(-m // tile))) for m in (n, n if own else b.count()))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.withColumn("i", block(na)).withColumn("j", spread(nb)).withColumn("left", F.lit(True))
    right = b.withColumn("j", block(nb)).withColumn("i", spread(na)).withColumn("left", F.lit(False))
    if own:  # the half above the diagonal of blocks, whose blocks are sent once
        left, right = left.where("i <= j"), right.where("i < j")

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        x, y = t.filter(t.column("left")), t.filter(pc.invert(t.column("left")))
        twice = own and key[0].as_py() != key[1].as_py()
        y = x if own and not twice else y
        if x.num_rows and y.num_rows:
            yield from similarities(x.column("id").to_numpy(), matrix(x.column("v")), y.column("id").to_numpy(), matrix(y.column("v")), metric, diagonal_one, tile, twice, digits)

    return left.unionByName(right).repartition(min(2 * na * nb, 2_000), "i", "j").groupBy("i", "j").applyInArrow(meet, MATRIX)


# Inverted file.


def scalable_lists(n: int) -> tuple[int, int]:
    """Numbers of lists and of probes for n expected vectors."""
    lists = min(1024, max(16, int(2 * n**0.5)))
    return lists, max(1, lists // 16)


def nearest_lists(rows: DataFrame, centroids: np.ndarray, probes: int, metric: Metric | str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v, cell, order: the `probes` nearest centroids of each vector. Centroids are at most some thousand vectors."""
    own = rows.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))
    metric = Metric(metric)
    kind = rows.schema[vector_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = own.value
        at = np.arange(len(c))
        for b in batches:
            if b.num_rows:
                d = distances(matrix(b.column("v")), c, metric)
                order = np.stack([np.lexsort((at, row))[:probes] for row in d])
                i = np.repeat(np.arange(b.num_rows), order.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(i)), b.column("v").take(pa.array(i)), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(order.shape[1], dtype=np.int32), b.num_rows))], names=["id", "v", "cell", "order"])

    picked = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return picked.mapInArrow(run, f"id long, v {kind}, cell int, order int")


def train_centroids(rows: DataFrame, lists: int, rounds: int = 10, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """k-means centroids by Lloyd's rounds: assignment in Arrow batches, sums merged over partitions; an empty list keeps its centroid. Starts from vectors chosen by hash."""
    picked = rows.where(F.col(vector_col).isNotNull())
    start = picked.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(lists).select(vector_col).collect()
    c = np.array([r[0] for r in start], float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                at = distances(x, c, Metric.EUCLIDEAN).argmin(1)
                np.add.at(total, at, x)
                n += np.bincount(at, minlength=len(c))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(list(total)), pa.array(n)], names=["cell", "total", "n"])

    for _ in range(rounds if len(c) else 0):
        merged = picked.select(vector_col).mapInArrow(sums, "cell int, total array<double>, n long").groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(d))).alias(f"d{d}") for d in range(c.shape[1])]).collect()  # a row per list
        new = c.copy()
        for r in merged:
            if r["n"]:
                new[r["cell"]] = np.array([r[f"d{d}"] for d in range(c.shape[1])]) / r["n"]
        moved = np.abs(new - c).max()
        c = new
        if moved < 1e-9:
            break
    return c


def ivf_assign(store: DataFrame, centroids: np.ndarray, metric: Metric | str = Metric.EUCLIDEAN, **cols) -> DataFrame:
    """id, v, cell of each vector: to be written partitioned by cell, so that a search prunes to the probed cells."""
    return nearest_lists(store, centroids, 1, metric, **cols).drop("order")


def ivf_search(assigned: DataFrame, queries: DataFrame, centroids: np.ndarray, probes: int, k: int = 10, metric: Metric | str = Metric.EUCLIDEAN, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16_384) -> DataFrame:
    """The k nearest among the vectors of each query's `probes` nearest cells; may be fewer than k.

    Cells meet their queries as blocks of `block` vectors at most, each a matrix product that keeps k rows a query; no pairs are made.
    """
    metric = Metric(metric)
    sizes = {r[0]: r[1] for r in assigned.groupBy("cell").count().collect()}  # a row for each list
    if not sizes:
        return ranked(queries.sparkSession.createDataFrame([], HITS), k, metric)
    probed = nearest_lists(queries, centroids, probes, metric, id_col, vector_col).select("id", "v", "cell")
    return ranked(meet_cells(probed, assigned.select("id", "v", "cell"), [sizes.get(c, 0) for c in range(max(sizes) + 1)], metric, k, block), k, metric)


def meet_cells(probed: DataFrame, held: DataFrame, sizes, metric: Metric, k: int, block: int = 16_384) -> DataFrame:
    """query_id, id, distance: the k nearest of each block of at most `block` vectors (held: id, v, cell) of the cells that queries (probed: id, v, cell) go to.

    sizes: vectors by cell. A block meets its queries in a matrix product that keeps k rows a query; no pairs are made.
    """
    blocks = F.array(*[F.lit(int(-(-int(n) // block))) for n in sizes])
    parts = F.get(blocks, F.col("cell"))
    held = held.withColumn("part", F.pmod(F.xxhash64("id"), F.greatest(parts, F.lit(1))).cast("int"))
    probed = probed.withColumn("n", F.coalesce(parts, F.lit(0))).where("n > 0")
    probed = probed.select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if q.num_rows and x.num_rows:
            ids, v = x.column("id").to_numpy(), matrix(x.column("v"))
            for at in range(0, q.num_rows, 1024):
                some = q.slice(at, 1024).combine_chunks()
                found.append(nearest(some.column("id").to_numpy(), matrix(some.column("v")), ids, v, metric, k, False))
        out = [np.concatenate([f[i] for f in found]) if found else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, float))]
        return pa.table(dict(zip(("query_id", "id", "distance"), map(pa.array, out), strict=True)))

    return probed.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInArrow(meet, HITS)


def top_of(hits: DataFrame, k: int) -> DataFrame:
    """Each query's k best hits, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: share of the exact hits that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))


def distances_from(store: DataFrame, query: list[float], metric: Metric | str = Metric.COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, distance of every vector of the store from one query, by the pairwise rule; a vector of another length raises."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = same_length(store.where(F.col(vector_col).isNotNull()), vector_col, len(query))
    return rows.select(F.col(id_col).alias("id"), V.distance(F.col(vector_col), q, Metric(metric)).alias("distance"))
