"""Length buckets, micro-batches, priorities and batch sizes, as relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

#: Batch size up to each memory pressure; the larger size holds where ranges meet.
BY_PRESSURE = ((0.3, 128), (0.6, 64), (0.8, 32), (1.0, 16))
#: Share of the latency that a request of each priority waits at most, and its order.
LATENCY = {"urgent": 0.25, "high": 0.5, "normal": 1.0, "low": 3.0}
PRIORITY = {"low": 0, "normal": 1, "high": 2, "urgent": 3}


def bucket_key(length: Column, bucket: int = 16, max_tokens: int = 512) -> Column:
    """Length rounded up to a multiple of `bucket` (one bucket at least), at most max_tokens."""
    return F.least(F.lit(max_tokens), (F.ceil(F.greatest(F.lit(1), length) / bucket) * bucket).cast("int"))


def batch_capacity(key: Column, max_batch: int = 32, max_tokens: int | None = None, min_batch: int = 1) -> Column:
    """Rows of a micro-batch of that key."""
    cap = F.lit(max_batch) if max_tokens is None else F.least(F.lit(max_batch), F.greatest(F.lit(1), F.floor(F.lit(max_tokens) / key).cast("int")))
    return F.greatest(F.lit(min_batch), cap)


def micro_batches(rows: DataFrame, length: Column, id_col: str, max_batch: int = 32, bucket: int = 16, max_length: int = 512, max_tokens: int | None = None, padding_ratio: float | None = None, min_batch: int = 1, shard: Column | None = None) -> DataFrame:
    """The rows with bucket_key, shard, batch (number in the key's shard) and padding (tokens added).

    Rows of a key in order of length and id are cut every `capacity` rows. With padding_ratio r, rows shorter than ceil(key * (1 - r)) are batches of their own.
    shard (by default 1024 classes by hash) deals the rows of each key into sequences of their own, so that a key with most of the rows is not one group.
    """
    cap = batch_capacity(F.col("bucket_key"), max_batch, max_tokens, min_batch)
    short = F.lit(False) if padding_ratio is None else F.col("_len") < F.ceil(F.col("bucket_key") * (1 - max(0.0, min(1.0, padding_ratio))))
    d = rows.withColumn("_len", length).withColumn("bucket_key", bucket_key(F.col("_len"), bucket, max_length)).withColumn("shard", (F.pmod(F.xxhash64(id_col), F.lit(1024)) if shard is None else shard).cast("int")).withColumn("_short", short)
    w = Window.partitionBy("bucket_key", "shard", "_short").orderBy("_len", id_col)
    number = F.row_number().over(w) - 1
    alone = F.sum(F.col("_short").cast("int")).over(Window.partitionBy("bucket_key", "shard"))
    d = d.withColumn("batch", F.when(F.col("_short"), number).otherwise(alone + F.floor(number / cap)).cast("int"))
    return d.withColumn("padding", (F.col("bucket_key") - F.least(F.col("_len"), F.col("bucket_key"))).cast("int")).drop("_len", "_short")


def optimal_batch(pressure: Column, max_batch: int = 128, table: Sequence[tuple[float, int]] = BY_PRESSURE) -> Column:
    """Batch size for a memory pressure from 0 to 1."""
    out = F.lit(max_batch)
    for top, size in reversed(table):
        out = F.when(pressure <= top, F.lit(min(size, max_batch))).otherwise(out)
    return F.when((pressure < 0) | (pressure > 1), F.lit(max_batch)).otherwise(out)


def latency_limit(priority: Column, base: float = 0.1, low: float = LATENCY["low"]) -> Column:
    """Seconds that a request of a priority may wait."""
    out = F.lit(None).cast("double")
    for name, share in LATENCY.items():
        out = F.when(priority == name, F.lit(base * (low if name == "low" else share))).otherwise(out)
    return out


def should_flush(size: Column, oldest_age: Column, high_age: Column, urgent: Column, pressure: Column, base: float = 0.1, min_batch: int = 1) -> Column:
    """Whether a queue is to be processed now: full, expired, under pressure, with an urgent request, or with a high one half through its time."""
    some = size > 0
    return some & ((size >= optimal_batch(pressure)) | (oldest_age >= base) | ((pressure > 0.8) & (size >= min_batch)) | urgent | ((high_age >= base * 0.5) & (size >= min_batch)))


def priority_order(rows: DataFrame, priority: str, seq: str, size: int, key: str | None = None) -> DataFrame:
    """The rows with position and batch when higher priorities go first, each in order of seq; per `key` if given."""
    rank = F.coalesce(*[F.when(F.col(priority) == n, F.lit(v)) for n, v in PRIORITY.items()], F.lit(PRIORITY["normal"]))
    ordered = ranks.numbered(rows.withColumn("_rank", rank), [key] if key else [], [F.desc("_rank"), F.col(seq)])
    return ordered.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("int")).withColumn("position", F.col("position").cast("int")).drop("_rank")


def effective_batch_size(base: int, memory: str, least: int = 1) -> int:
    """Batch size under a memory warning: whole, half (warning) or a quarter (critical), `least` at least."""
    return max(least, int(base * {"normal": 1.0, "warning": 0.5, "critical": 0.25}[memory]))


def progress(done: int, total: int, elapsed: float) -> dict:
    """Items a second, seconds left and phase of a batch run."""
    rate = done / elapsed if elapsed > 0 else 0.0
    return {"fraction": done / total if total else 1.0, "items_per_second": rate, "eta": (total - done) / rate if rate else None, "phase": "Processing" if done < total else "Finalizing"}
