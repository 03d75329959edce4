"""Rate limiters over events, by event time.

A limiter's state belongs to an identifier and moves with each of its events in order. In batch, events are dealt by identifier, sorted inside partitions and
walked in Arrow batches with only the state held, so an identifier of any size needs no memory; the sliding window is a range window and needs no walk. In a stream the
same states live in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType


@dataclass(frozen=True)
class TokenBucket:
    """Admits while tokens are left; they come back at `refill` a second up to `capacity`. A new identifier has a full bucket."""

    capacity: float
    refill: float

    def start(self, t: float) -> tuple:
        return self.capacity, t

    def step(self, state: tuple, t: float, cost: float) -> tuple[tuple, bool]:
        tokens = min(self.capacity, state[0] + (t - state[1]) * self.refill)
        ok = tokens >= cost
        return (tokens - cost * ok, t), ok


@dataclass(frozen=True)
class FixedWindow:
    """Admits the first `most` requests of a window, which starts at the first request and anew at the first one after it has passed; denied ones count."""

    most: int
    seconds: float

    def start(self, t: float) -> tuple:
        return t, 0

    def step(self, state: tuple, t: float, cost: float) -> tuple[tuple, bool]:
        begin, n = state if t - state[0] < self.seconds else (t, 0)
        return (begin, n + 1), n + 1 <= self.most


@dataclass(frozen=True)
class LeakyBucket:
    """Admits while the level is below capacity; one unit leaks every `every` seconds, and fractions of that time are kept."""

    capacity: int
    every: float

    def start(self, t: float) -> tuple:
        return 0, t

    def step(self, state: tuple, t: float, cost: float) -> tuple[tuple, bool]:
        leaked = int((t - state[1]) / self.every)
        level, last = (max(0, state[0] - leaked), state[1] + leaked * self.every) if leaked > 0 else state
        ok = level < self.capacity
        return (level + ok, last), ok


def adaptive(base: float, load: float) -> TokenBucket:
    """A token bucket whose capacity shrinks with the load (0 to 1); it refills in ten seconds. An identifier keeps the bucket that it started with."""
    capacity = base * (2 - max(0.0, min(1.0, load)))
    return TokenBucket(capacity, capacity / 10)


Limiter = TokenBucket | FixedWindow | LeakyBucket


def limit(events: DataFrame, limiter: Limiter, id_col: str, ts_col: str, order_col: str, cost_col: str | None = None) -> DataFrame:
    """id_col, order_col, allowed for each event, in order of time and order_col. Costs are 1 unless a column has them."""
    cost = F.col(cost_col).cast("double") if cost_col else F.lit(1.0)
    d = events.select(F.col(id_col), F.col(order_col), (F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6).alias("_t"), cost.alias("_c")).where(F.col("_t").isNotNull())
    d = d.repartition(F.col(id_col)).sortWithinPartitions(id_col, "_t", order_col)
    kinds = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (id_col, order_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = object(), ()
        for b in batches:
            out = []
            for who, t, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if who != held:
                    held, state = who, limiter.start(t)
                state, ok = limiter.step(state, t, c)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], names=[id_col, order_col, "allowed"])

    return d.mapInArrow(run, f"{kinds}, allowed boolean")


def left(limiter: Limiter, state: tuple, t: float) -> float:
    """Requests of cost 1 (for a bucket: cost) that a limiter would admit at time t, without making any."""
    if isinstance(limiter, TokenBucket):
        return min(limiter.capacity, state[0] + (t - state[1]) * limiter.refill)
    if isinstance(limiter, FixedWindow):
        return float(max(0, limiter.most - (state[1] if t - state[0] < limiter.seconds else 0)))
    return float(max(0, limiter.capacity - max(0, state[0] - int((t - state[1]) / limiter.every))))


def status(events: DataFrame, limiter: Limiter, id_col: str, ts_col: str, order_col: str, cost_col: str | None = None, at: str | None = None) -> DataFrame:
    """id_col, last (time of the last event, in seconds), remaining and limited of each identifier after its events, at the time `at` (a timestamp as text), else at
    its own last event. Identifiers are walked in sorted partitions, with one state held."""
    cost = F.col(cost_col).cast("double") if cost_col else F.lit(1.0)
    now = F.unix_micros(F.lit(at).cast("timestamp")) / 1e6 if at else F.lit(None).cast("double")
    d = events.select(F.col(id_col), F.col(order_col), (F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6).alias("_t"), cost.alias("_c"), now.alias("_now")).where(F.col("_t").isNotNull())
    d = d.repartition(F.col(id_col)).sortWithinPartitions(id_col, "_t", order_col)
    kind = events.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, last, end = object(), (), 0.0, None
        done: list[tuple] = []
        for b in batches:
            for who, t, c, n in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if who != held:
                    if state:
                        done.append((held, last, left(limiter, state, last if end is None else max(last, end))))
                    held, state = who, limiter.start(t)
                state, _ = limiter.step(state, t, c)
                last, end = t, n
            yield table(done)
            done = []
        if state:
            yield table([(held, last, left(limiter, state, last if end is None else max(last, end)))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        whos, lasts, lefts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(whos, to_arrow_type(kind)), pa.array(lasts, pa.float64()), pa.array(lefts, pa.float64()), pa.array([x < 1 for x in lefts], pa.bool_())], [id_col, "last", "remaining", "limited"])

    return d.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, last double, remaining double, limited boolean")


def sliding_window(events: DataFrame, most: int, seconds: int, id_col: str, ts_col: str, order_col: str) -> DataFrame:
    """id_col, order_col, allowed: at most `most` requests, denied ones among them, in the `seconds` up to and with each."""
    w = Window.partitionBy(id_col).orderBy(F.unix_micros(F.col(ts_col).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.select(id_col, order_col, (F.count("*").over(w) <= most).alias("allowed"))


def aligned_window(events: DataFrame, most: int, width: str, id_col: str, ts_col: str) -> DataFrame:
    """Requests of each identifier in each clock-aligned window, and how many of them are over the limit; also for streams with a watermark."""
    n = F.count("*")
    return events.groupBy(id_col, F.window(ts_col, width).alias("window")).agg(n.alias("requests"), F.greatest(F.lit(0), n - most).alias("denied"))


def ordered(frames: Iterator[pd.DataFrame], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """The frames' rows in order of time and order, in frames of at most `rows`. A batch's events of one identifier are held, as numbers."""
    whole = pd.concat(list(frames), ignore_index=True).sort_values(["t", "order"], kind="stable", ignore_index=True)
    for k in range(0, len(whole), rows):
        yield whole.iloc[k : k + rows]


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = StructType([StructField(n, DoubleType()) for n in ("a", "b", "last")])


class _Walker(StatefulProcessor):
    """One identifier's state in a stream: two numbers of the limiter and the time of its last event."""

    def __init__(self, limiter: Limiter, idle: float | None):
        self.limiter, self.idle = limiter, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("limiter", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A batch's events of the identifier in order: they are sorted by time and order first."""
        now = self.held.get()
        state, last = (now[:2], now[2]) if now is not None else (None, None)
        for pdf in ordered(rows):
            out = []
            for t, cost, gone in zip(pdf["t"], pdf["cost"], pdf["reset"], strict=True):
                if state is None or gone or (self.idle is not None and t - last > self.idle):
                    state = self.limiter.start(t)
                state, ok = self.limiter.step(state, t, cost)
                out.append(ok)
                last = t if last is None else max(last, t)
            yield pd.DataFrame({"who": pdf["who"], "order": pdf["order"], "allowed": out})
        if state is not None:
            self.held.update((float(state[0]), float(state[1]), float(last)))
            if self.idle is not None:
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int((last + self.idle) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The identifier was idle for so long that the watermark has passed: it leaves the state."""
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, limiter: Limiter, id_col: str, ts_col: str, order_col: str, cost_col: str | None = None, reset_col: str | None = None, idle: float | None = None, delay: str = "0 seconds") -> DataFrame:
    """The same as `limit` for a streaming DataFrame: states are kept in the state store from batch to batch. Only RocksDB has what it takes, so the session's
    queries that start from now on use that.

    Events of a batch are walked in order of time, then order_col; batches as they come, so an event that comes in a later batch than one behind it is walked
    after that. reset_col: events that begin a new state, as after a reset. idle: seconds after which an identifier without events starts anew; once the
    watermark, `delay` behind the latest event, has passed that, its state is removed. Without idle, states stay.
    """
    kinds = ", ".join(f"{n} {events.schema[c].dataType.simpleString()}" for n, c in (("who", id_col), ("order", order_col)))
    cost = F.col(cost_col).cast("double") if cost_col else F.lit(1.0)
    reset = F.coalesce(F.col(reset_col).cast("boolean"), F.lit(False)) if reset_col else F.lit(False)
    ts = F.col(ts_col).cast("timestamp")
    d = events.where(ts.isNotNull()).select(F.col(id_col).alias("who"), F.col(order_col).alias("order"), (F.unix_micros(ts) / 1e6).alias("t"), cost.alias("cost"), reset.alias("reset"), ts.alias("at"))
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    d = d.withWatermark("at", delay) if idle is not None else d
    out = d.groupBy("who").transformWithStateInPandas(_Walker(limiter, idle), f"{kinds}, allowed boolean", "append", "EventTime" if idle is not None else "None")
    return out.select(F.col("who").alias(id_col), F.col("order").alias(order_col), "allowed")


def limiter_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """id, level, since, last: what a stream of limit_stream holds for each identifier, read from its checkpoint: the two numbers of its limiter (tokens and
    time, begin and count, or level and time) and the time of its last event."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "limiter").load()
    return held.select(held["key"].getField(held.schema["key"].dataType.fieldNames()[0]).alias("id"), F.col("value.a").alias("level"), F.col("value.b").alias("since"), F.col("value.last").alias("last"))
