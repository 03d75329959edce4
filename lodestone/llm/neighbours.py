"""Exact top-k by inner product over a pivot-distance index.

Vectors are lifted to one more dimension, so that all have the same length and a larger inner product is a smaller distance. Each is keyed by its nearest
pivot and its distance from it, sorted by that key and cut into blocks of one pivot, each an annulus; consecutive blocks make a group, of which a directory
holds the annuli by pivot. A query is itself a row of the index: the k-th best score in its own block is its first radius. By the triangle inequality only
vectors whose pivot distance is within the radius of the query's can be better, so a query goes to those groups alone that have an annulus in reach; there
annuli are searched from the nearest on while the radius shrinks, and in an annulus only the rows within it. Queries, sorted by the same key, meet groups in
blocks, never as rows; a group of the index is shipped once for each block of queries that reaches it.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors only meet those of their own length; rows with the
query's own id are not its neighbours; repeated rows count each, as neighbours, and as queries once if they are equal, and rows of one id with different
vectors are one query, whose best scores count; ties go to the smaller id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

INDEX = "part int, before long, dim int, pivot int, low double, high double, n int, ids binary, asks binary, reach binary, vectors binary"
INDEX_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 4]
#: kth: the k-th best score that is known, null if there are not so many.
ASKED = "part int, before long, query_id long, v array<double>, kth double"
HIT = "query_id long, vec_id long, score long"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def usable(vectors: DataFrame, query: Column, vector_col: str, id_col: str, scale: float) -> DataFrame:
    """vec_id, v: floor(scale * component) of each usable vector, and whether it asks."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))


def norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def pivots_of(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """By dimension, at most `count` pivots in all, chosen by hash: the sample that the index is fitted on."""
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()
    out: dict[int, list] = {}
    for r in taken:
        out.setdefault(len(r["v"]), []).append(r["v"])
    return {k: np.unique(np.array(v, float).reshape(len(v), k), axis=0) for k, v in out.items()}


def matrix(batch: pa.RecordBatch, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension, row numbers and vectors of a list column."""
    col = batch.column(name)
    size, flat = np.diff(col.offsets.to_numpy()), col.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(size)])
    out = {}
    for d in np.unique(size):
        k = np.flatnonzero(size == d)
        out[int(d)] = (k, flat[(at[k][:, None] + np.arange(d)).astype(int)].reshape(len(k), int(d)))
    return out


def distances(x: np.ndarray, lift2: np.ndarray, p: np.ndarray, most: float) -> np.ndarray:
    """Lifted distances of rows x (their last coordinate squared: lift2) from pivots p."""
    plift = np.sqrt(np.maximum(most - (p * p).sum(1), 0))
    d2 = ((x * x).sum(1) + lift2)[:, None] + ((p * p).sum(1) + plift**2)[None, :] - 2 * (x @ p.T + np.sqrt(np.maximum(lift2, 0))[:, None] * plift[None, :])
    return np.sqrt(np.maximum(d2, 0))


def indexed(rows: DataFrame, own: Broadcast, block: int) -> DataFrame:
    """The annuli: rows sorted by (pivot, distance) over all partitions and cut into blocks of one dimension and pivot. before: rows of the partition before a block."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, top = own.value
        for b in batches:
            pivot, reach = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            for d, (at, x) in matrix(b, "v").items():
                if d in table:
                    dist = distances(x, top - (x * x).sum(1), table[d], top)
                    pivot[at] = dist.argmin(1)
                    reach[at] = dist.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(reach)], names=["vec_id", "v", "asks", "pivot", "reach"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, before = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            nonlocal before
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            pivot, ids, reach = (t.column(c).to_numpy() for c in ("pivot", "vec_id", "reach"))
            asks = t.column("asks").to_numpy(zero_copy_only=False)
            out = []
            for d, (at, x) in matrix(t, "v").items():
                for p in np.unique(pivot[at]):
                    m = np.flatnonzero(pivot[at] == p)
                    m = m[np.argsort(reach[at][m], kind="stable")]
                    r = reach[at][m]
                    out.append((part, before, d, int(p), float(r[0]), float(r[-1]), len(m), ids[at][m].astype("<i8").tobytes(), asks[at][m].astype(np.uint8).tobytes(), r.tobytes(), x[m].tobytes()))
                    before += len(m)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(INDEX_KINDS)], names=names_of(INDEX))

        for b in batches:
            for at in range(0, b.num_rows, block):
                held.append(b.slice(at, block))
                if sum(x.num_rows for x in held) >= block:
                    yield flush()
        if held:
            yield flush()

    placed = rows.mapInArrow(keyed, "vec_id long, v array<double>, asks boolean, pivot int, reach double")
    return staged(placed.repartitionByRange(parts, "pivot", "reach", "vec_id").sortWithinPartitions("pivot", "reach", "vec_id").mapInArrow(blocks, INDEX))


def unpacked(b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, pivot distances and vectors of a block."""
    return np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["reach"]), np.frombuffer(b["vectors"]).reshape(b["n"], -1)


def askers(index: DataFrame, k: int) -> DataFrame:
    """The queries, each with the k-th best score in its own block; before: queries of the partition before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[int, int] = {}
        for batch in batches:
            for b in batch.to_pylist():
                ids, _, x = unpacked(b)
                on = np.flatnonzero(np.frombuffer(b["asks"], np.uint8))
                if not len(on):
                    continue
                s = x[on] @ x.T
                s[ids[on][:, None] == ids[None, :]] = -np.inf
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(on), -np.inf)
                at = counted.get(b["part"], 0)
                counted[b["part"]] = at + len(on)
                kinds = pa.array(x[on].ravel()), np.arange(len(on) + 1, dtype=np.int32) * x.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(kinds[1]), kinds[0])
                yield pa.RecordBatch.from_arrays([pa.array([b["part"]] * len(on), pa.int32()), pa.array(at + np.arange(len(on))), pa.array(ids[on]), lists, pa.array(kth, mask=~np.isfinite(kth))], names=names_of(ASKED))

    return staged(index.mapInArrow(run, ASKED).dropDuplicates(["query_id", "v"]))


def numbered(rows: DataFrame, size: Column, per: int, name: str) -> tuple[DataFrame, int]:
    """rows, which have a part and the number of units before them in it, with a number that grows by one every `per` units over all partitions; and all units."""
    held = sorted((r[0], r[1]) for r in rows.groupBy("part").agg(F.sum(size)).collect())  # a row for each partition
    offsets, total = {}, 0
    for part, n in held:
        offsets[part] = total
        total += n
    at = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("part")) if offsets else F.lit(0)
    return rows.withColumn(name, F.floor((at + F.col("before")) / per).cast("int")), total


def reaching(asked: DataFrame, directory: Broadcast, own: Broadcast) -> DataFrame:
    """The queries with grp, a row for each group that has an annulus within the radius of a query's k-th best score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, top = own.value
        for b in batches:
            groups: list[list[int]] = [[] for _ in range(b.num_rows)]
            kth = b.column("kth").to_numpy(zero_copy_only=False).astype(float)
            for d, (at, q) in matrix(b, "v").items():
                radius, slack = radius_of(q, kth[at], top)
                far = distances(q, np.zeros(len(q)), table[d], top) if d in table else None
                for grp, dim, pivot, low, high in directory.value:
                    if dim == d:
                        gap = np.zeros(len(q)) if pivot < 0 else np.maximum(low - far[:, pivot], far[:, pivot] - high)
                        for i in at[gap <= radius + slack].tolist():
                            groups[i].append(grp)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sorted(set(g)) for g in groups], pa.list_(pa.int32()))], names=[*b.schema.names, "groups"])

    more = asked.mapInArrow(run, f"{ASKED}, qblock int, groups array<int>")
    return more.select("query_id", "v", "kth", "qblock", F.explode("groups").alias("grp"))


def radius_of(q: np.ndarray, kth: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """The lifted distance of a vector with the k-th best score (infinite where that is not known), and what rounding may take from a distance."""
    q2 = (q * q).sum(1)
    return np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(q2 + top - 2 * np.nan_to_num(kth), 0))), 1e-6 * np.sqrt(top + q2) + 1e-6


def top_k(vectors: DataFrame, query: Column, k: int = 5, scale: float = 256.0, pivots: int = 64, block: int = 2048, group: int = 32768, query_block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floored vectors, exactly.

    query: condition that makes a row a query; pivots: vectors that the index is fitted on; block: rows of an annulus at most; group, query_block: rows of
    the index and queries that a task holds at most. Tables with fewer rows than fill a group for every core have smaller groups; beyond 100,000 groups they
    grow, so that the directory, which is broadcast, has that many and as many as there are pivots.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, query, vector_col, id_col, scale)
    most = rows.agg(F.max(norm2(F.col("v")))).first()[0] or 0.0
    own = spark.sparkContext.broadcast((pivots_of(rows, pivots), float(most)))  # at most `pivots` vectors
    index = indexed(rows, own, block)
    total = index.agg(F.sum("n")).first()[0] or 0
    per = max(min(group, -(-total // (2 * spark.sparkContext.defaultParallelism))), block, total // 100_000)
    index, _ = numbered(index, F.col("n"), per, "grp")
    asked, _ = numbered(askers(index.drop("grp"), k), F.lit(1), query_block, "qblock")
    annuli = index.groupBy("grp", "dim", "pivot").agg(F.min("low"), F.max("high")).collect()
    asked = reaching(asked, spark.sparkContext.broadcast([tuple(r) for r in annuli]), own)
    asked = staged(asked)
    wanted = asked.select(F.col("qblock").alias("met"), "grp").distinct()  # a row for each pair of blocks that meet
    sent = index.join(wanted, "grp").drop("part", "before", "asks")

    def search(queries: pa.Table, held: pa.Table) -> pa.Table:
        table, top = own.value
        found: list[np.ndarray] = []
        if queries.num_rows and held.num_rows:
            q = queries.select(["query_id", "v", "kth"]).combine_chunks().to_batches()[0]
            here = held.to_pylist()
            kth = q.column("kth").to_numpy(zero_copy_only=False).astype(float)
            for d, (at, x) in matrix(q, "v").items():
                found += expand(q.column("query_id").to_numpy()[at], x, kth[at], [b for b in here if b["dim"] == d], table.get(d), top, k)
        rows_ = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        return pa.table([pa.array(rows_[:, i]) for i in range(3)], names=names_of(HIT))

    found = asked.groupBy("qblock", "grp").cogroup(sent.groupBy("met", "grp")).applyInArrow(search, HIT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def expand(qid: np.ndarray, q: np.ndarray, kth: np.ndarray, blocks: list[dict], pivots: np.ndarray | None, top: float, k: int) -> list[np.ndarray]:
    """Up to k rows (query, vector, score) of the blocks for each query, none below its k-th best score, nearest annuli first, until no annulus can hold a better one."""
    q2 = (q * q).sum(1)
    radius, slack = radius_of(q, kth, top)
    best_score, best_id, best_of = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
    far = distances(q, np.zeros(len(q)), pivots, top) if pivots is not None else None
    near = [(np.maximum(0, np.maximum(b["low"] - far[:, b["pivot"]], far[:, b["pivot"]] - b["high"])) if b["pivot"] >= 0 else np.zeros(len(q))) for b in blocks]
    for j in sorted(range(len(blocks)), key=lambda j: float(near[j].mean())):
        b = blocks[j]
        on = np.flatnonzero(near[j] <= radius + slack)
        if not len(on):
            continue
        ids, reach, x = unpacked(b)
        lo, hi = 0, b["n"]
        if b["pivot"] >= 0:
            d = far[on, b["pivot"]]
            lo, hi = np.searchsorted(reach, (d - radius[on] - slack[on]).min()), np.searchsorted(reach, (d + radius[on] + slack[on]).max(), "right")
        if lo >= hi:
            continue
        s = q[on] @ x[lo:hi].T
        s[qid[on][:, None] == ids[lo:hi][None, :]] = -np.inf
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(on), -np.inf)
        floor = np.maximum(floor, (q2[on] + top - radius[on] ** 2) / 2 - slack[on])
        r, c = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
        best_of, best_id, best_score = np.concatenate([best_of, on[r]]), np.concatenate([best_id, ids[lo:hi][c]]), np.concatenate([best_score, s[r, c]])
        o = np.lexsort((best_id, -best_score, best_of))
        best_of, best_id, best_score = best_of[o], best_id[o], best_score[o]
        place = np.arange(len(o)) - np.searchsorted(best_of, best_of)
        keep = place < k
        best_of, best_id, best_score, place = best_of[keep], best_id[keep], best_score[keep], place[keep]
        last = place == k - 1
        radius[best_of[last]] = np.minimum(radius[best_of[last]], np.sqrt(np.maximum(q2[best_of[last]] + top - 2 * best_score[last], 0)))
    return [np.stack([qid[best_of], best_id, best_score.astype(np.int64)], axis=1)]
