"""Metrics as aggregations: histograms, floor-rank percentiles, hit rates, throughput, regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks

#: Histogram bounds in seconds.
BOUNDS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0)
PERCENTILES = (50.0, 75.0, 90.0, 95.0, 99.0, 99.9)


def bucket(value: Column, bounds: Sequence[float] = BOUNDS) -> Column:
    """Number of the first bucket whose bound is above the value; len(bounds) for the overflow."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= value))


def histogram(rows: DataFrame, value: str, by: Sequence[str] = (), bounds: Sequence[float] = BOUNDS) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*by, bucket(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(rows: DataFrame, value: str, by: Sequence[str] = (), wanted: Sequence[float] = PERCENTILES) -> DataFrame:
    """by, percentile, value at rank floor((n - 1) * p / 100) without interpolation.

    Equal values are counted before anything is sorted; ranks.selected finds the ranks, whatever a group's size.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return ranks.selected(counts, by, "value", "n", wanted)


def approximate_percentiles(rows: DataFrame, value: str, by: Sequence[str] = (), wanted: Sequence[float] = PERCENTILES, accuracy: int = 10_000) -> DataFrame:
    """The same in one pass with bounded memory."""
    return rows.groupBy(*by).agg(F.percentile_approx(value, [p / 100 for p in wanted], accuracy).alias("v")).select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in wanted]).alias("percentile"), F.col("v").alias("value"))).alias("x")).select(*by, "x.percentile", "x.value")


#: Of KLL sketches: size, and by how much a rank is off at most (with a probability of 0.99).
SKETCH_SIZE, SKETCH_ERROR = 200, 0.0133


def sketches(rows: DataFrame, value: str, by: Sequence[str], at: str, every: str = "1 hour", size: int = SKETCH_SIZE) -> DataFrame:
    """by, start, sketch, n, low, high: a KLL sketch of each group and time slice, some kilobytes whatever it holds. To be stored, and merged in any order."""
    slot = F.window(at, every)["start"].alias("start")
    kept = rows.where(F.col(value).isNotNull())
    return kept.groupBy(*by, slot).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"), F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def merged_sketches(sketched: DataFrame, by: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """by, sketch, n, low, high: the sketches of each group as one."""
    return sketched.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def moving_sketches(sketched: DataFrame, by: Sequence[str], slices: int, every_seconds: int = 3600) -> DataFrame:
    """by, start, sketch, n, low, high of the `slices` time slices up to each one: every sketch goes to the slices that it is part of and is merged there."""
    later = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_k")
    spread = sketched.select("*", later).withColumn("start", F.timestamp_seconds(F.unix_timestamp("start") + F.col("_k") * every_seconds))
    known = sketched.select(*by, "start").distinct()
    return merged_sketches(spread.join(known, [*by, "start"]), [*by, "start"])


def sketched_percentiles(merged: DataFrame, by: Sequence[str], wanted: Sequence[float] = PERCENTILES) -> DataFrame:
    """by, percentile, value, n: estimates whose rank is off by SKETCH_ERROR of n at most."""
    at = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias("value")) for p in wanted])
    return merged.select(*by, "n", F.explode(at).alias("x")).select(*by, "x.percentile", "x.value", "n")


def concurrency(rows: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """by, spans, peak, mean, busy and whole: how many spans of each group run at once at most and on average, how long any runs, and from the first start to
    the last end. start and end are numbers; a span holds its start and not its end, so one of no length never runs; a span without start or end, or that ends
    before it starts, is left out. A sweep over starts and ends, summed up over range partitions.
    """
    spans = rows.where(F.col(end) >= F.col(start)).select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"))
    edges = spans.select(*by, F.explode(F.array(F.struct(F.col("_s").alias("t"), F.lit(1).alias("d"), F.lit(1).alias("n")), F.struct(F.col("_e").alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("n")))).alias("x")).select(*by, "x.*")
    level = ranks.running(edges, by, "t", "d")
    lasts = F.col("next") - F.col("t")
    area = level.groupBy(*by).agg(F.max("level").alias("peak"), F.sum(F.col("level") * lasts).alias("_area"), F.coalesce(F.sum(F.when(F.col("level") > 0, lasts)), F.lit(0)).alias("busy"), (F.max("t") - F.min("t")).alias("whole"))
    count = spans.groupBy(*by).agg(F.count("*").alias("spans"))
    both = area.crossJoin(count) if not by else area.join(count, [*by])
    return both.select(*by, "spans", "peak", F.when(F.col("whole") > 0, F.col("_area") / F.col("whole")).otherwise(F.lit(0.0)).alias("mean"), "busy", "whole")


def stage_metrics(rows: DataFrame, seconds: str, items: str, by: Sequence[str] = ()) -> DataFrame:
    """Runs, items, total, mean, least and largest seconds, mean batch size and items a second of each stage."""
    total = F.sum(seconds)
    return rows.groupBy(*by).agg(
        F.count("*").alias("runs"), F.sum(items).alias("items"), total.alias("total_seconds"), F.avg(seconds).alias("mean_seconds"), F.min(seconds).alias("least_seconds"), F.max(seconds).alias("most_seconds"),
        F.avg(items).alias("mean_batch"), F.when(total > 0, F.sum(items) / total).otherwise(F.lit(0.0)).alias("items_per_second"),
    )


def summary(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def latest(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), size: int = 1024) -> DataFrame:
    """The last `size` rows of each group: the window over which latencies are kept."""
    return ranks.numbered(rows, by, [F.desc(c) for c in order], "_k").where(F.col("_k") <= size).drop("_k")


def throughput(rows: DataFrame, tokens: str, seconds: str, by: Sequence[str] = ()) -> DataFrame:
    """Requests, mean latency and tokens a second by model or stage."""
    return rows.groupBy(*by).agg(F.count("*").alias("requests"), F.avg(seconds).alias("mean_latency"), F.when(F.sum(seconds) > 0, F.sum(tokens) / F.sum(seconds)).otherwise(F.lit(0.0)).alias("tokens_per_second"))


def hit_rates(rows: DataFrame, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """Rates of cache lookups by outcome (exact, semantic, miss)."""
    n = F.count("*")
    share = lambda *names: F.when(n > 0, F.count_if(F.col(outcome).isin(*names)) / n).otherwise(F.lit(0.0))
    return rows.groupBy(*by).agg(n.alias("lookups"), share("exact").alias("exact_rate"), share("semantic").alias("semantic_rate"), share("exact", "semantic").alias("hit_rate"))


def regression_report(current: DataFrame, baseline: DataFrame, metric: str = "metric", value: str = "value", threshold: float = 0.1) -> DataFrame:
    """Relative change of each metric against its baseline; regressed where a cost grew by more than the threshold."""
    j = current.select(metric, F.col(value).alias("current")).join(baseline.select(metric, F.col(value).alias("baseline")), metric)
    change = F.when(F.col("baseline") != 0, (F.col("current") - F.col("baseline")) / F.col("baseline")).otherwise(F.lit(0.0))
    return j.withColumn("change", change).withColumn("regressed", F.col("change") > threshold)


def stream_statistics(rows: DataFrame, outcome: str, seconds: str) -> DataFrame:
    """Submitted, processed and dropped requests, drop rate and mean processing time."""
    n = F.count("*")
    dropped = F.count_if(F.col(outcome) == "dropped")
    return rows.agg(n.alias("submitted"), F.count_if(F.col(outcome) == "processed").alias("processed"), dropped.alias("dropped"), F.when(n > 0, dropped / n).otherwise(F.lit(0.0)).alias("drop_rate"), F.coalesce(F.avg(F.when(F.col(outcome) == "processed", F.col(seconds))), F.lit(0.0)).alias("mean_seconds"))


def queue_counts(rows: DataFrame, priority: str, waiting: str) -> DataFrame:
    """Requests and those that still wait, by priority."""
    return rows.groupBy(priority).agg(F.count("*").alias("requests"), F.count_if(F.col(waiting)).alias("queued"))


def report_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each row of a report."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
