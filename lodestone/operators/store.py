"""Vector stores: relations of id, vector, text, metadata, stored_at, changed by an append-only log and kept as versioned Parquet folders.

A store's folder holds snapshots, a small record for each of them, and a log that any number of writers append to (see wal). The state is the newest snapshot
with the later operations of the log applied, the last of each id; a checkpoint writes it as the next snapshot. Records and commits are put where nothing is
yet, so of two checkpoints one wins, and nothing that is being read is overwritten. The snapshot of a trained index is partitioned by cell (see cells), with
a directory of the cells, so a search reads the cells in its reach; what the log has changed since is searched flat and replaces its rows of the snapshot.

Rows of a snapshot are numbered in order of their ids, so ties among equal distances go to the smaller id.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, StoreError
from ..models import Embedder, embed, embed_once
from ..plans.config import IndexConfig
from ..sources.shared import Files, written
from . import cells
from . import rerank as R
from . import search as S
from .wal import Log, latest, numbered_by

SCHEMA = "id string, vector array<float>, text string, metadata map<string,string>, stored_at timestamp"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def upsert(store: DataFrame, changes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The store with changes (rows with seq, ascending) applied; the last change of an id wins. A row without id gets a random one."""
    new = changes.withColumn(key, F.coalesce(F.col(key), F.expr("uuid()").cast(changes.schema[key].dataType)) if changes.schema[key].dataType.simpleString() == "string" else F.col(key))
    both = store.withColumn(seq, F.lit(-1).cast("long")).unionByName(new, allowMissingColumns=True)
    return latest(both, [key], [F.col(seq)]).drop(seq)


def remove(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The store without those ids; ids that it has not are no error."""
    return store.join(ids.select(key).distinct(), key, "left_anti")


def contains(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    known = store.select(key).distinct().withColumn("found", F.lit(True))
    return ids.select(key).distinct().join(known, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def statistics(store: DataFrame, text_col: str = "text", vector_col: str = "vector") -> DataFrame:
    """Number of rows and bytes: text, four bytes an element, 200 a row."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 4 * F.coalesce(F.size(vector_col), F.lit(0)) + 200
    return store.agg(F.count("*").alias("count"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"))


def replay(snapshot: DataFrame, log: DataFrame, after: int = -1) -> DataFrame:
    """The state after the log's operations (put, delete) with seq above `after`; replaying twice changes nothing."""
    cols = snapshot.columns
    ops = log.where(F.col("seq") > after)
    both = snapshot.withColumn("seq", F.lit(-1).cast("long")).withColumn("op", F.lit("put")).unionByName(ops.select("seq", "op", *cols))
    return latest(both, ["id"], [F.col("seq")]).where("op = 'put'").select(*cols)


class VectorStore:
    """A store at a path. All reads give DataFrames of the current state."""

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig):
        self.spark, self.path, self.config, self.files = spark, path.rstrip("/"), config, Files(spark)
        self.wal = Log(spark, f"{self.path}/log", "op string, " + SCHEMA)

    @staticmethod
    def create(spark: SparkSession, path: str, config: IndexConfig) -> VectorStore:
        s = VectorStore(spark, path, config)
        if not s._write(spark.createDataFrame([], SCHEMA), {"version": -1}, -1):
            raise StoreError(f"there is a store at {path}")
        return s

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorStore:
        s = VectorStore(spark, path, None)
        state = s._state()
        if state["version"] < 0:
            raise StoreError(f"no store at {path}")
        s.config = IndexConfig.from_dict(state["config"])
        return s

    # State

    def _state(self) -> dict:
        """The newest record: version, seq (the last one of the log that the snapshot holds), folder, config, trained."""
        names = self.files.names(f"{self.path}/versions")
        if not names:
            return {"version": -1, "seq": -1, "trained": False}
        return json.loads(self.files.read(f"{self.path}/versions/{max(names)}"))

    def _write(self, rows: DataFrame, state: dict, seq: int, centroids: np.ndarray | None = None) -> bool:
        """A snapshot of rows, made from `state`, and its record; False, and nothing left of it, if another one has been written since."""
        version, folder = state["version"] + 1, f"data-{uuid.uuid4().hex}"
        numbered = numbered_by(rows, "id", "row")
        if centroids is None:
            numbered.write.parquet(f"{self.path}/{folder}/rows")
        else:
            placed = cells.with_cells(numbered, centroids, self.config.metric)  # a cell of any size is cut by row; there are about cells + partitions files
            placed.repartitionByRange("cell", "row").write.partitionBy("cell").parquet(f"{self.path}/{folder}/rows")
            written = self.spark.read.schema(f"row long, {SCHEMA}, far double, cell int").parquet(f"{self.path}/{folder}/rows")
            cells.directory_of(written, centroids).coalesce(1).write.parquet(f"{self.path}/{folder}/cells")
        record = {"version": version, "seq": seq, "folder": folder, "config": self.config.to_dict(), "trained": centroids is not None}
        if self.files.put(f"{self.path}/versions/{version:010d}.json", json.dumps(record)):
            return True
        self.files.delete(f"{self.path}/{folder}")
        return False

    def _cells(self, state: dict) -> cells.Directory:
        return cells.Directory.read(self.spark.read.parquet(f"{self.path}/{state['folder']}/cells"), self.config.metric)

    def _snapshot(self, state: dict) -> DataFrame:
        tail = ", far double, cell int" if state["trained"] else ""
        return self.spark.read.schema(f"row long, {SCHEMA}{tail}").parquet(f"{self.path}/{state['folder']}/rows")

    def snapshot(self) -> DataFrame:
        return self._snapshot(self._state()).select(*NAMES)

    def log(self) -> DataFrame | None:
        """The operations (seq, op, row) that the snapshot does not hold yet."""
        return self.wal.read(self._state()["seq"])

    def _rows(self, state: dict, top: int) -> DataFrame:
        """The rows of a snapshot with the log's operations up to `top`."""
        log = self.wal.read(state["seq"])
        rows = self._snapshot(state).select(*NAMES)
        return rows if log is None else replay(rows, log.where(F.col("seq") <= top))

    def rows(self) -> DataFrame:
        """The current rows: the snapshot, and the log's later operations if there are any."""
        state = self._state()
        return self._rows(state, self.wal.last(state["seq"]))

    # Changes

    def append(self, changes: DataFrame) -> tuple[int, int] | None:
        """Log rows (id, vector, text, metadata and, for their order, seq if there is one) as puts, in one commit; null ids get random ones. The numbers they got."""
        c = changes
        for name, kind in (("id", "string"), ("vector", "array<float>"), ("text", "string"), ("metadata", "map<string,string>"), ("stored_at", "timestamp")):
            value = F.col(name).cast(kind) if name in c.columns else F.lit(None).cast(kind)
            if name == "id":
                value = F.coalesce(value, F.expr("uuid()"))
            if name == "text" and not self.config.store_text:
                value = F.lit(None).cast("string")
            if name == "stored_at":
                value = F.coalesce(value, F.current_timestamp())
            c = c.withColumn(name, value)
        wrong = F.raise_error(F.lit(f"{DimensionMismatch.__name__}: a vector has not {self.config.dimension} elements")).cast("array<float>")
        c = c.withColumn("vector", F.when(F.size("vector") == self.config.dimension, F.col("vector")).otherwise(wrong)).withColumn("op", F.lit("put"))
        order = F.col("seq").cast("long") if "seq" in changes.columns else F.monotonically_increasing_id()
        return self.wal.append(c.select(order.alias("_o"), "op", *NAMES), F.col("_o"), self._state()["seq"])

    def delete(self, ids: DataFrame) -> tuple[int, int] | None:
        blank = [F.lit(None).cast(k).alias(n) for n, k in (("vector", "array<float>"), ("text", "string"), ("metadata", "map<string,string>"), ("stored_at", "timestamp"))]
        gone = ids.select(F.lit("delete").alias("op"), F.col("id").cast("string"), *blank)
        return self.wal.append(gone, F.col("id"), self._state()["seq"])

    def add_texts(self, texts: DataFrame, model: Embedder) -> tuple[int, int] | None:
        """Embed rows (text, and id and metadata if there are any) and store them; equal texts are embedded once."""
        keyed = texts.withColumn("id", F.coalesce(F.col("id").cast("string"), F.expr("uuid()")) if "id" in texts.columns else F.expr("uuid()"))
        keyed = written(keyed)  # random ids are drawn once
        vectors = embed_once(keyed, model, "id", "text")
        return self.append(keyed.drop("vector").join(vectors, "id"))

    # Maintenance

    def checkpoint(self, keep: int = 2, grace: float = 3600.0) -> bool:
        """A new snapshot with the log applied; False if another checkpoint came first. Then the log is cut behind it and all but the newest `keep` snapshots
        go; small commit files stay for `grace` seconds, for writers that are about to commit."""
        state = self._state()
        top = self.wal.last(state["seq"])
        if not self._write(self._rows(state, top), state, top, self._cells(state).centroids if state["trained"] else None):
            return False
        self._prune(keep)
        self.wal.truncate(top, state["seq"], grace)
        return True

    compact = checkpoint

    def flush(self) -> int:
        """The last sequence number that is committed: what append returned is durable, there is nothing in memory to write."""
        return self.wal.last(self._state()["seq"])

    def _prune(self, keep: int) -> None:
        for name in sorted(self.files.names(f"{self.path}/versions"))[:-keep]:
            folder = json.loads(self.files.read(f"{self.path}/versions/{name}"))["folder"]
            self.files.delete(f"{self.path}/{folder}")
            self.files.delete(f"{self.path}/versions/{name}")

    def recover(self, grace: float = 86_400.0) -> dict:
        """After a crash: what no commit and no record names, older than `grace` seconds, is removed. The state's numbers and what was removed."""
        state = self._state()
        segments = self.wal.drop_orphans(state["seq"], grace)
        known = {json.loads(self.files.read(f"{self.path}/versions/{n}"))["folder"] for n in self.files.names(f"{self.path}/versions")}
        lost = [n for n, age in self.files.names(self.path).items() if n.startswith("data-") and n not in known and age >= grace]
        for n in lost:
            self.files.delete(f"{self.path}/{n}")
        return {"version": state["version"], "checkpoint": state["seq"], "dropped_segments": segments, "dropped_snapshots": len(lost), **self.log_statistics()}

    def log_statistics(self) -> dict:
        """Segments, rows, bytes, first and last sequence number of the log behind the snapshot."""
        return self.wal.statistics(self._state()["seq"])

    def clear(self) -> None:
        state = self._state()
        self._write(self.spark.createDataFrame([], SCHEMA), state, self.wal.last(state["seq"]))

    def train(self, rounds: int = 10) -> bool:
        """Cells by k-means over the current rows, and a snapshot kept by them; False if there is no vector or another snapshot came first."""
        state = self._state()
        top = self.wal.last(state["seq"])
        rows = written(self._rows(state, top))
        c = S.train_centroids(cells.unit_rows(rows, self.config.metric), self.config.lists, rounds, id_col="id", vector_col="vector")
        return bool(len(c)) and self._write(rows, state, top, c)

    @property
    def is_trained(self) -> bool:
        return self.config.kind == "flat" or self._state()["trained"]

    # Search

    def search_many(self, queries: DataFrame, k: int = 10, where: Column | None = None, min_similarity: float | None = None, probes: int | None = None, with_vectors: bool = False) -> DataFrame:
        """query_id, rank, id, distance, similarity, text and metadata of the k nearest rows of each query (query_id long, vector).

        A trained index reads the cells in reach; probes: at most so many for each query, by default as many as it takes for the exact result.
        """
        cols = ["query_id", "rank", "id", "distance", "similarity", "text", "metadata", *(["vector"] if with_vectors else [])]
        queries = queries.select(F.col("query_id").cast("long").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("v")).where("v IS NOT NULL")
        queries = S.same_length(queries, "v", self.config.dimension)
        state = self._state()
        rows, log = self._snapshot(state), self.wal.read(state["seq"])
        changed = None
        if log is not None:
            changed = written(numbered_by(latest(log, ["id"], ["seq"]), "id", "row"))
            rows = rows.join(changed.select("id"), "id", "left_anti")
        found = []
        for part, trained in ((rows, state["trained"]), (None if changed is None else changed.where("op = 'put'"), False)):
            if part is None or k <= 0:
                continue
            if trained:
                hits = cells.search(part, self._cells(state), queries, k, probes, where)
            else:
                hits = S.knn(part, queries.withColumnsRenamed({"id": "row", "v": "vector"}), k, self.config.metric, where, id_col="row", vector_col="vector", dim=self.config.dimension)
            hits = hits.select("query_id", F.col("id").alias("row"), "distance")
            found.append(hits.join(part.select("row", "id", "text", "metadata", "vector"), "row").drop("row"))
        if not found:
            return self.spark.createDataFrame([], f"query_id long, rank int, id string, distance double, similarity double, text string, metadata map<string,string>{', vector array<float>' if with_vectors else ''}")
        both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        out = S.ranked(both, k, self.config.metric, extra=["text", "metadata", "vector"]).select(*cols)
        return out if min_similarity is None else S.min_similarity(out, min_similarity)

    def search(self, query: list[float], k: int = 10, where: Column | None = None, min_similarity: float | None = None, probes: int | None = None) -> DataFrame:
        """id, rank, distance, similarity, text and metadata of the k nearest rows; where: a filter on the store's columns, as `metadata['lang'] = 'en'`."""
        if len(query) != self.config.dimension:
            raise DimensionMismatch(f"the query has {len(query)} elements, the store {self.config.dimension}")
        q = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, vector array<double>")
        return self.search_many(q, k, where, min_similarity, self.config.probes if probes is None and self.config.kind == "ivf" else probes).drop("query_id")

    def search_texts(self, texts: DataFrame, model: Embedder, k: int = 10, where: Column | None = None, strategy: R.Strategy | None = None, multiplier: int = R.MULTIPLIER["default"]) -> DataFrame:
        """query_id, rank, id, distance, similarity, text and metadata of the k nearest rows of each text (query_id, text).

        With a strategy, multiplier * k candidates are found and reranked by their vectors.
        """
        queries = written(embed(texts.withColumn("query_id", F.col("query_id").cast("long")), model, "query_id", "text"))
        if strategy is None:
            return self.search_many(queries, k, where)
        hits = written(self.search_many(queries, max(1, multiplier) * k, where, with_vectors=True).withColumn("n", F.monotonically_increasing_id()))
        doubles = F.transform("vector", lambda x: x.cast("double"))
        best = R.rerank(hits.select("query_id", "rank", F.col("n").alias("id"), "distance", "similarity", doubles.alias("embedding")), queries.withColumn("vector", doubles), k, strategy, "query_id", "vector")
        return best.select("query_id", "rank", F.col("id").alias("n"), "distance", "similarity").join(hits.select("n", "id", "text", "metadata"), "n").select("query_id", "rank", "id", "distance", "similarity", "text", "metadata")

    def search_text(self, text: str, model: Embedder, k: int = 10, **how) -> DataFrame:
        """The same for one text."""
        return self.search_texts(self.spark.createDataFrame([(0, text)], "query_id long, text string"), model, k, **how).drop("query_id")

    def statistics(self) -> DataFrame:
        return statistics(self.rows())

    def export_json(self, path: str) -> None:
        self.rows().write.mode("overwrite").json(path)

    def import_json(self, path: str) -> None:
        self.append(self.spark.read.schema(SCHEMA).json(path))
