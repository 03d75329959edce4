"""Vectors as short codes: each part of an integer vector is named by the nearest entry of a codebook, which Lloyd's rounds fit by Hamerly's bounds.

A row keeps for each part its entry, one upper bound of the distance to it and one lower bound of the distance to the second nearest; after each round the
table of rows is written anew. When entries have moved, the upper bound grows by the own entry's move, the lower one shrinks by the largest move of all; where
the upper bound is then strictly below the lower one, or below half the way from the entry to its nearest other entry, the part keeps its entry. Else the
upper bound is made exact and tried again, and only then are all entries compared, in integers, the lowest index winning ties. Bounds are rounded outwards, so a
strict comparison never hides a tie. Partial sums of each entry's parts are made in the tasks and added up by Spark.

Defined results: rows whose vector is null or holds null or non-finite components are left out, as are those with a component of 2**16 or more, whose squared
distances may exceed 64 bits, and those of another length than that of the first row by id; a length that the parts don't divide is filled up with zeros;
the first entries are rows by id, null ids last, then by vector; fewer rows than entries make as many entries; repeated rows count each; null labels are a group;
an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import joined_by_key, release, staged

LIMIT = 2.0**16
FAR = 1e300
STATE = "entry array<int>, upper array<double>, lower array<double>, full array<boolean>"
SUMS = "part int, entry int, held long, sums array<long>"
OUTWARD = 1e-9


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vectors: DataFrame, vector: str, limit: float = LIMIT) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= limit))
    return vectors.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows from all entries. Sums of products below 2**53 are exact as doubles, others are taken as integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[1] < 2**53:
        a, b = x.astype(float), book.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in book], 1)


def own(x: np.ndarray, book: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((x - book[entry]) ** 2).sum(1)


def scan(x: np.ndarray, book: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the nearest entry, the lowest of equals, its distance and the second nearest entry's, with bounds rounded outwards."""
    entry, upper, lower = np.zeros(len(x), np.int32), np.zeros(len(x)), np.full(len(x), FAR)
    for k in range(0, len(x), rows):
        d = squared(x[k : k + rows], book)
        at, n = d.argmin(1), np.arange(len(d))
        entry[k : k + rows], upper[k : k + rows] = at, np.sqrt(d[n, at]) * (1 + OUTWARD)
        if len(book) > 1:
            d[n, at] = np.iinfo(np.int64).max
            lower[k : k + rows] = np.sqrt(d.min(1)) * (1 - OUTWARD)
    return entry, upper, lower


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry went, at least."""
    return np.sqrt(((new - old) ** 2).sum(1)) * (1 + OUTWARD)


def half_ways(book: np.ndarray) -> np.ndarray:
    """Half the distance from each entry to its nearest other one, at most."""
    if len(book) < 2:
        return np.full(len(book), FAR)
    d = squared(book, book)
    np.fill_diagonal(d, np.iinfo(np.int64).max)
    return np.sqrt(d.min(1)) / 2 * (1 - OUTWARD)


def reassigned(x: np.ndarray, old: np.ndarray, book: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """entry, upper, lower after the codebook `old` became `book`, and which rows were compared with all entries."""
    went, half = moved(old, book), half_ways(book)
    upper, lower = (upper + went[entry]) * (1 + OUTWARD), np.maximum(lower * (1 - OUTWARD) - went.max(initial=0), 0)
    reach = np.maximum(lower, half[entry])
    loose = np.flatnonzero(~(upper < reach))
    upper[loose] = np.sqrt(own(x[loose], book, entry[loose])) * (1 + OUTWARD)
    full = loose[~(upper[loose] < reach[loose])]
    entry, out = entry.copy(), np.zeros(len(x), bool)
    entry[full], upper[full], lower[full] = scan(x[full], book)
    out[full] = True
    return entry, upper, lower, out


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False) if len(column) else np.zeros((0, 0), kind)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), kind))


def assigner(old: np.ndarray | None, book: np.ndarray):
    """Rows with their state after the codebooks (part, entry, position) became `book`; without `old`, a first full comparison."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), np.int64).reshape(b.num_rows, len(book), -1)
            if old is None:
                found = [(*scan(x[:, p], book[p]), np.ones(len(x), bool)) for p in range(len(book))]
            else:
                entry, upper, lower = (matrix(b.column(n), k) for n, k in (("entry", np.int32), ("upper", float), ("lower", float)))
                found = [reassigned(x[:, p], old[p], book[p], entry[:, p], upper[:, p], lower[:, p]) for p in range(len(book))]
            state = [lists(np.stack(c, 1), kind) for c, kind in zip(zip(*found, strict=True), (pa.int32(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("v"), *state], ["row", "v", "entry", "upper", "lower", "full"])

    return assign


def summer(parts: int, entries: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each entry used in this partition, its parts' count and sums."""
        held, total = np.zeros(parts * entries, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            x, entry = matrix(b.column("v"), np.int64), matrix(b.column("entry"), np.int64)
            x, at = x.reshape(len(x) * parts, -1), (entry + np.arange(parts) * entries).ravel()
            total = np.zeros((parts * entries, x.shape[1]), np.int64) if total is None else total
            order = np.argsort(at, kind="stable")
            used, start = np.unique(at[order], return_index=True)
            total[used] += np.add.reduceat(x[order], start, axis=0)
            held += np.bincount(at, minlength=len(held))
        if total is not None:
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(at // entries, pa.int32()), pa.array(at % entries, pa.int32()), pa.array(held[at]), lists(total[at], pa.int64())], ["part", "entry", "held", "sums"])

    return sums


def updated(rows: DataFrame, book: np.ndarray) -> np.ndarray:
    """Each entry as the floor of its parts' mean; unused ones stay. The driver gets one row for each entry in use."""
    parts, entries, width = book.shape
    partial = rows.select("v", "entry").mapInArrow(summer(parts, entries), SUMS)
    total = partial.groupBy("part", "entry").agg(F.sum("held").alias("held"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)])
    out = book.copy()
    for r in total.collect():
        out[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["held"]
    return out


def fit(vectors: DataFrame, vector: str, order: Column, keep: list[Column], parts: int, entries: int, rounds: int, scale: int) -> tuple[DataFrame, np.ndarray]:
    """(row: the columns `keep`, v: integers, entry: each part's code), and the codebooks as (part, entry, position).

    What the driver holds is the codebooks: parts x entries x width integers.
    """
    good = usable(vectors, vector).select(F.struct(*keep).alias("row"), order.alias("key"), integers(F.col(vector), scale).alias("v"))
    first = good.orderBy(F.col("key").asc_nulls_last(), "v").select("v").limit(entries).collect()
    dim = len(first[0]["v"]) if first else 0
    width = max(-(-dim // parts), 1)
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), parts * width - dim))
    rows = good.where(F.size("v") == dim).select("row", filled.alias("v"))
    start = [[*r["v"], *[0] * (parts * width - dim)] for r in first if len(r["v"]) == dim]
    if len(start) < len(first):  # other lengths among the first: take the first of the right one
        start = [r["v"] for r in good.where(F.size("v") == dim).orderBy(F.col("key").asc_nulls_last(), "v").select(filled.alias("v")).limit(entries).collect()]
    book = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    kind, old = StructType([*rows.schema.fields, *StructType.fromDDL(STATE).fields]), None
    for k in range(rounds + 1):
        last, rows = rows, staged(rows.mapInArrow(assigner(old, book), kind))
        if k:
            release(last)
        if k < rounds:
            old, book = book, updated(rows, book)
    return rows, book


def hex_code(entry: Column) -> Column:
    return F.lower(F.array_join(F.transform(entry, lambda e: F.lpad(F.hex(e), 2, "0")), ""))


def errors(rows: DataFrame, book: np.ndarray) -> DataFrame:
    """rows with error: the squared distances of a row's parts from their entries, summed."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, entry = matrix(b.column("v"), np.int64).reshape(b.num_rows, len(book), -1), matrix(b.column("entry"), np.int64)
            far = sum(own(x[:, p], book[p], entry[:, p]) for p in range(len(book)))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("entry"), pa.array(far, pa.int64())], ["row", "entry", "error"])

    rows = rows.select("row", "v", "entry")
    return rows.mapInArrow(measure, StructType([*rows.drop("v").schema.fields, StructField("error", LongType())]))


def codebooks_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int, vector: str = "embedding", id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (the errors of equal labels, summed) and codebooks_sha256, with how many parts the last round compared in full."""
    rows, book = fit(vectors, vector, F.col(id_col), [F.col(id_col).alias("vec_id"), F.col(label).alias("label")], parts, entries, rounds, scale)
    rows = rows.withColumn("row", F.col("row").withField("scanned", F.size(F.filter("full", lambda f: f))))
    coded = staged(errors(rows, book).select("row.*", hex_code(F.col("entry")).alias("code"), "error"))
    keyed = coded.withColumns({"unlabelled": F.col("label").isNull(), "of": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = staged(keyed.groupBy("unlabelled", "of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")))
    met = joined_by_key(keyed, sums, ["unlabelled", "of"], "rows", coded.count())
    return met.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(book)).alias("codebooks_sha256"), "scanned")
