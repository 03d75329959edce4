"""An embedding cache as a relation: text_hash, text, vector, model_id, dimensions, token_count, created_at, accessed_at, access_count; one row for each hash and model."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..errors import CacheError
from ..functions.text import text_hash
from ..functions.vectors import Metric
from ..models import Embedder, embed
from ..sources.shared import Files, written
from . import ranks
from .search import distances, matrix

SCHEMA = "text_hash string, text string, vector array<float>, model_id string, dimensions int, token_count int, created_at timestamp, accessed_at timestamp, access_count long"
KEY = ["text_hash", "model_id"]


def entry_size() -> Column:
    return F.octet_length("text") + 4 * F.size("vector") + 200


def entries(rows: DataFrame, now: Column, model_id: str, text_col: str = "text", vector_col: str = "vector") -> DataFrame:
    """Cache rows for texts and their vectors."""
    return rows.select(text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"), F.col(vector_col).alias("vector"), F.lit(model_id).alias("model_id"), F.size(vector_col).alias("dimensions"), F.size(F.split(F.trim(text_col), r"\s+")).alias("token_count"), now.alias("created_at"), now.alias("accessed_at"), F.lit(1).cast("long").alias("access_count"))


def insert_absent(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the new rows whose hash and model it has not yet; of several, the one of the least text."""
    once = new.groupBy(*KEY).agg(F.min_by(F.struct(*new.columns), F.col("text")).alias("_r")).select("_r.*")
    return cache.unionByName(once.join(cache.select(*KEY), KEY, "left_anti"))


def lookup(cache: DataFrame, requests: DataFrame, model_id: str, text_col: str = "text") -> DataFrame:
    """The requests with text_hash, hit and vector, by exact hash."""
    r = requests.withColumn("text_hash", text_hash(text_col)).withColumn("model_id", F.lit(model_id))
    found = cache.select(*KEY, F.col("vector").alias("_v"), F.lit(True).alias("_hit"))
    return r.join(found, KEY, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).withColumnRenamed("_v", "vector").drop("_hit")


def recent(cache: DataFrame, model_id: str, size: int = 1000) -> DataFrame:
    """The most recently accessed rows of a model."""
    return cache.where(F.col("model_id") == model_id).orderBy(F.desc("accessed_at"), "text_hash").limit(size)


def lookup_semantic(cache: DataFrame, requests: DataFrame, model_id: str, threshold: float = 0.9, size: int = 1000, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """id, text_hash, similarity of the likest of the `size` most recent rows that reaches the threshold; of equal ones the most recent.

    Those rows, of bounded number, go to every task as one matrix; each batch of requests is one product, and no pairs are made.
    """
    rows = recent(cache, model_id, size).select("text_hash", F.unix_micros(F.col("accessed_at").cast("timestamp")).alias("at"), "vector").collect()
    dim = max((len(r["vector"]) for r in rows), default=0)
    rows = sorted((r for r in rows if len(r["vector"]) == dim), key=lambda r: (r["at"], r["text_hash"]), reverse=True)
    own = cache.sparkSession.sparkContext.broadcast(([r["text_hash"] for r in rows], np.array([r["vector"] for r in rows], float).reshape(len(rows), dim)))
    kind = requests.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, x = own.value
        for b in batches:
            if b.num_rows and len(hashes):
                s = 1 - distances(matrix(b.column(1)), x, Metric.COSINE)
                best = s.argmax(1)  # the first of equal ones, which is the most recent
                top = s[np.arange(len(s)), best]
                ok = np.flatnonzero(top >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array([hashes[i] for i in best[ok]], pa.string()), pa.array(top[ok])], names=[id_col, "text_hash", "similarity"])

    asked = requests.where((F.size(vector_col) == dim) & F.col(vector_col).isNotNull()).select(id_col, vector_col)
    return asked.mapInArrow(run, f"`{id_col}` {kind}, text_hash string, similarity double")


def touch(cache: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """The cache with hits (hash and model) counted and their access time set."""
    n = hits.groupBy(*KEY).agg(F.count("*").alias("_n"))
    c = cache.join(n, KEY, "left")
    return c.withColumn("accessed_at", F.when(F.col("_n").isNotNull(), now).otherwise(F.col("accessed_at"))).withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).drop("_n").select(*cache.columns)


def evict_expired(cache: DataFrame, before: Column) -> DataFrame:
    """Rows accessed before that time go."""
    return cache.where(F.col("accessed_at") >= before)


def evict_least_recent(cache: DataFrame, count: int) -> DataFrame:
    """The `count` least recently accessed rows go. Only their keys are sorted out, which takes a top-k and no global sort."""
    gone = cache.orderBy("accessed_at", *KEY).limit(max(count, 0)).select(*KEY)
    return cache.join(gone, KEY, "left_anti")


def evict_over_size(cache: DataFrame, max_bytes: int, max_count: int | None = None, block: int = 100) -> DataFrame:
    """Least recently accessed rows go in blocks until at most max_bytes are left; before that, count - max_count + block rows if there are max_count rows.

    Rows are numbered and blocks summed up by range partitions, so no task sorts the whole cache, however its accesses lie in time.
    """
    n = cache.count()
    if max_count is not None and n >= max_count:
        cache = evict_least_recent(cache, n - max_count + block)
    keys = cache.select(*KEY, "accessed_at", entry_size().cast("long").alias("_size"))
    placed = written(ranks.numbered(keys, [], ["accessed_at", *KEY]).select(*KEY, F.floor((F.col("position") - 1) / block).alias("_block"), "_size"))
    later = ranks.running(placed.withColumn("_back", -F.col("_block")), [], "_back", "_size")  # a block and all that are more recent
    kept = later.where(F.col("level") <= max_bytes).select((-F.col("_back")).alias("_block"))
    return cache.join(placed.join(kept, "_block", "left_semi").select(*KEY), KEY, "left_semi")


def rates(lookups: DataFrame) -> DataFrame:
    from .measures import hit_rates

    return hit_rates(lookups, "outcome")


def remove(cache: DataFrame, texts: DataFrame, model_id: str, text_col: str = "text") -> DataFrame:
    """The cache without the entries of the texts for a model."""
    gone = texts.select(text_hash(text_col).alias("text_hash"), F.lit(model_id).alias("model_id")).distinct()
    return cache.join(gone, KEY, "left_anti")


def clear(cache: DataFrame, model_id: str | None = None) -> DataFrame:
    """The cache without the entries of a model, or without any."""
    return cache.where(F.lit(False)) if model_id is None else cache.where(~F.col("model_id").eqNullSafe(F.lit(model_id)))


def warm(cache: DataFrame, texts: DataFrame, model: Embedder, now: Column, text_col: str = "text") -> DataFrame:
    """The cache with entries for those texts that it does not hold yet, each distinct one embedded once."""
    missing = texts.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct().withColumn("text_hash", text_hash("text"))
    missing = missing.join(cache.where(F.col("model_id") == model.name).select("text_hash"), "text_hash", "left_anti").groupBy("text_hash").agg(F.min("text").alias("text"))
    return insert_absent(cache, entries(missing.join(embed(missing, model, "text_hash"), "text_hash"), now, model.name))


class CacheTable:
    """A cache at a path, as versions of which each names the batches it has taken, for one writer that may repeat a batch after a failure.

    A version is a folder, and a small record that is put where none is; it carries, for each stream, the number of the last batch. A batch that is not
    above it changes nothing, so a repeated one counts no hit twice.
    """

    def __init__(self, spark: SparkSession, path: str, model: Embedder, ttl: float | None = None, max_bytes: int | None = None, keep: int = 2):
        self.spark, self.path, self.model, self.ttl, self.max_bytes, self.keep, self.files = spark, path.rstrip("/"), model, ttl, max_bytes, keep, Files(spark)

    def state(self) -> dict:
        names = self.files.names(f"{self.path}/versions")
        return json.loads(self.files.read(f"{self.path}/versions/{max(names)}")) if names else {"version": -1, "folder": None, "batches": {}}

    def rows(self) -> DataFrame:
        folder = self.state()["folder"]
        return self.spark.createDataFrame([], SCHEMA) if folder is None else self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{folder}")

    def take(self, requests: DataFrame, batch: int, stream: str = "requests", text_col: str = "text", at_col: str = "at") -> bool:
        """A batch of requests (a text, and its time): hits are counted and their access time set, missing texts are embedded, each once, and put; then what is
        over the time to live before the batch's last request, and over the size, goes. False if the batch was taken before.
        """
        state = self.state()
        if batch <= state["batches"].get(stream, -1):
            return False
        asked = written(requests.select(text_hash(text_col).alias("text_hash"), F.lit(self.model.name).alias("model_id"), F.col(text_col).alias("text"), F.col(at_col).cast("timestamp").alias("at")).where("text IS NOT NULL"))
        uses = asked.groupBy(*KEY).agg(F.count("*").alias("_n"), F.max("at").alias("_at"), F.min("at").alias("_first"), F.min("text").alias("_text"))
        cache = self.rows()
        held = cache.join(uses, KEY, "left")
        held = held.withColumns({"accessed_at": F.greatest("accessed_at", "_at"), "access_count": F.col("access_count") + F.coalesce("_n", F.lit(0))}).select(*cache.columns)
        missing = written(uses.join(cache.select(*KEY), KEY, "left_anti"))
        vectors = embed(missing, self.model, "text_hash", "_text").join(missing, "text_hash")
        new = entries(vectors.withColumn("text", F.col("_text")), F.col("_first"), self.model.name)
        new = new.join(missing.select(*KEY, "_n", "_at"), KEY).withColumns({"accessed_at": F.col("_at"), "access_count": F.col("_n")}).select(*cache.columns)
        merged = held.unionByName(new)
        if self.ttl is not None:
            now = asked.agg(F.max("at")).first()[0]
            merged = merged if now is None else evict_expired(merged, F.lit(now) - F.make_dt_interval(secs=F.lit(float(self.ttl))))
        if self.max_bytes is not None:
            merged = evict_over_size(written(merged), self.max_bytes)
        return self._put(merged, state, state["batches"] | {stream: batch})

    def _put(self, rows: DataFrame, state: dict, batches: dict) -> bool:
        version, folder = state["version"] + 1, f"data-{uuid.uuid4().hex}"
        rows.select(*[f.name for f in StructType.fromDDL(SCHEMA)]).write.parquet(f"{self.path}/{folder}")
        if not self.files.put(f"{self.path}/versions/{version:010d}.json", json.dumps({"version": version, "folder": folder, "batches": batches})):
            self.files.delete(f"{self.path}/{folder}")
            raise CacheError(f"another writer put version {version} of {self.path}")
        for name in sorted(self.files.names(f"{self.path}/versions"))[: -self.keep]:
            self.files.delete(f"{self.path}/{json.loads(self.files.read(f'{self.path}/versions/{name}'))['folder']}")
            self.files.delete(f"{self.path}/versions/{name}")
        return True

    def follow(self, stream: DataFrame, checkpoint: str, name: str = "requests", once: bool = True, **cols: str) -> StreamingQuery:
        """Takes each micro-batch of a stream of requests."""
        writer = stream.writeStream.foreachBatch(lambda df, batch: self.take(df, batch, name, **cols) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
