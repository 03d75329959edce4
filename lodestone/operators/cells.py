"""Search in vectors that are kept by cells, with partition pruning and a stop by the triangle inequality.

Cells have a centroid, a radius (the distance of their farthest vector) and a size; the directory of all cells is small (a row for each list) and held by the
driver, the vectors are a table partitioned by cell. A query first goes to its nearest cells, as many as it takes to hold k vectors. The k-th distance found
there is a bound: a cell that lies farther off than that, by its centroid's distance less its radius, can hold no better vector. Only the cells within
reach are read then. Without a limit on the probes the result is exact; with one, the nearest cells in reach are read up to it. Both reads name the cells they
want, which prunes the table's partitions.

Distances of cells: cosine in the space of unit vectors, the others in their own metric; for inner products the largest product that a cell's ball allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import vectors as V
from ..functions.vectors import Metric
from ..sources.shared import written
from . import search as S

#: Bounds are loosened by this share of their size, so that rounding rules nothing out.
SLACK = 1e-6


@dataclass
class Directory:
    """Centroids (a row each), radii and sizes; cells are numbered by row."""

    centroids: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    metric: Metric

    @staticmethod
    def read(rows: DataFrame, metric: Metric | str) -> Directory:
        """From a table of cell, centroid, radius, n: a row for each list."""
        got = rows.orderBy("cell").collect()
        return Directory(np.array([r["centroid"] for r in got], float), np.array([r["radius"] for r in got]), np.array([r["n"] for r in got]), Metric(metric))


def placed(x: np.ndarray, metric: Metric) -> np.ndarray:
    """Vectors in the space where their cells lie."""
    if metric is not Metric.COSINE:
        return x
    n = np.sqrt((x * x).sum(1))[:, None]
    return np.where(n > V.TINY, x / np.where(n > V.TINY, n, 1), 0)


def unit_rows(rows: DataFrame, metric: Metric | str, vector: str = "vector") -> DataFrame:
    """rows with their vectors in the space where cells lie."""
    return rows.withColumn(vector, V.normalize(vector)) if Metric(metric) is Metric.COSINE else rows


def centroid_distances(x: np.ndarray, centroids: np.ndarray, metric: Metric) -> np.ndarray:
    """Distances that keep the triangle inequality."""
    if metric in (Metric.MANHATTAN, Metric.CHEBYSHEV):
        return S.distances(x, centroids, metric)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * (x @ centroids.T), 0))


def with_cells(rows: DataFrame, centroids: np.ndarray, metric: Metric | str, vector: str = "vector") -> DataFrame:
    """rows with cell and far, the distance from its centroid. Rows without vector have cell 0."""
    own, metric = rows.sparkSession.sparkContext.broadcast(np.asarray(centroids, float)), Metric(metric)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                held = b.column(vector).is_valid().to_numpy(zero_copy_only=False)
                cell, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
                if held.any():
                    d = centroid_distances(placed(S.matrix(b.column(vector).filter(pa.array(held))), metric), own.value, metric)
                    cell[held], far[held] = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])

    return rows.mapInArrow(assign, StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("far", DoubleType())]))


def directory_of(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cell, centroid, radius, n of every centroid; an empty cell has the radius 0."""
    spark = assigned.sparkSession
    all_cells = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    held = assigned.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    return all_cells.join(held, "cell", "left").fillna({"radius": 0.0, "n": 0})


def bounds(q: np.ndarray, d: Directory) -> tuple[np.ndarray, np.ndarray]:
    """For each query and cell the distance of the centroid, and what search distance a vector of the cell has at least."""
    x = placed(q, d.metric)
    near = centroid_distances(x, d.centroids, d.metric)
    reach = np.maximum(near - d.radius - SLACK * (near + d.radius), 0)
    if d.metric is Metric.EUCLIDEAN:
        return near, reach**2
    if d.metric is Metric.COSINE:
        return near, reach**2 / 2
    if d.metric is Metric.DOT:
        most = x @ d.centroids.T + np.sqrt((x * x).sum(1))[:, None] * d.radius
        return -most, -most - SLACK * np.abs(most)
    return near, reach


def probing(queries: DataFrame, d: Directory, k: int, probes: int | None, first: bool) -> DataFrame:
    """id, v, cell of the cells that each query (id, v, and bound if not first) goes to.

    first: the nearest cells that hold k vectors together; else those after them whose least distance is not over the bound, up to `probes` in all.
    """
    own = queries.sparkSession.sparkContext.broadcast(d)
    kind = queries.schema["v"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = own.value
        for b in batches:
            if not b.num_rows:
                continue
            near, least = bounds(S.matrix(b.column("v")), d)
            near[:, d.size == 0] = np.inf  # empty cells come last and are never read
            order = np.argsort(near, axis=1, kind="stable")
            before = np.cumsum(d.size[order], axis=1) - d.size[order]
            usable = np.take_along_axis(np.isfinite(near), order, 1)
            if probes is not None:
                usable &= np.arange(order.shape[1]) < probes
            start = before < k
            wanted = usable & start
            if not first:
                bound = b.column("bound").to_numpy(zero_copy_only=False)
                wanted = usable & ~start & ~(np.take_along_axis(least, order, 1) > bound[:, None])
            r, c = np.nonzero(wanted)
            at = pa.array(r)
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("v").take(at), pa.array(order[r, c].astype(np.int32))], ["id", "v", "cell"])

    return queries.mapInArrow(probe, f"id long, v {kind}, cell int")


def pruned(rows: DataFrame, wave: DataFrame) -> DataFrame:
    """The rows of the cells that the wave names, at most all lists, as a filter on the partition column."""
    wanted = [r["cell"] for r in wave.select("cell").distinct().collect()]
    return rows.where(F.col("cell").isin(wanted) if wanted else F.lit(False))


def search(rows: DataFrame, directory: Directory, queries: DataFrame, k: int, probes: int | None = None, where: Column | None = None, id_col: str = "row", vector: str = "vector", block: int = 16_384) -> DataFrame:
    """query_id, id, distance of each query's k nearest rows, with ties to the smaller id. queries: id (long), v.

    where: a filter on the rows; cells are then still counted whole, so a query may find fewer than k in its first cells and goes on without a bound.
    """
    metric, d = directory.metric, directory
    rows = rows if where is None else rows.where(where)
    held = lambda wave: pruned(rows, wave).where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"), "cell")
    wave = written(probing(queries, d, k, probes, True))
    hits = written(S.top_of(S.meet_cells(wave, held(wave), d.size, metric, k, block), k))
    bound = hits.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    bounded = queries.join(bound.withColumnRenamed("query_id", "id"), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    rest = written(probing(bounded, d, k, probes, False))
    more = S.meet_cells(rest, held(rest), d.size, metric, k, block)
    return S.top_of(hits.unionByName(more), k)
