"""Exact ranks, selections and running sums over groups of any size.

Rows are range-partitioned by group and order and sorted within partitions, so a group with most of the rows spreads over many of them. One row for each
partition and group, at most partitions + groups rows, tells how much a group has in each; prefix sums over those rows place every partition within its
group. No window runs over the rows of a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: As many short rows at most go to every task.
SMALL = 100_000


def placed(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """rows with part and seen, written once in order of `by` and `order`: seen grows with the order in a partition, part from one to the next.

    Rows that are equal in all of it are told apart by where they were read, so that they need not lie in one partition.
    """
    keys = [*[F.col(c) for c in by], *order, F.col("_where")]
    ranged = rows.withColumn("_where", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ranged.drop("_where").withColumns({"part": F.spark_partition_id(), "seen": F.monotonically_increasing_id()}))


def small(df: DataFrame) -> DataFrame:
    """df, written once; to be broadcast if it has few rows."""
    out = written(df)
    return F.broadcast(out) if out.count() <= SMALL else out


def starts(sorted_rows: DataFrame, by: Sequence[str], amount: Column) -> DataFrame:
    """by, part, first (the first row's `seen`), held, before and total: what a partition holds of a group, what lies before, and the group's whole amount."""
    group = Window.partitionBy(*by)
    held = sorted_rows.groupBy(*by, "part").agg(F.sum(amount).alias("held"), F.min("seen").alias("first"))
    return held.withColumns({"before": F.sum("held").over(group.orderBy("part")) - F.col("held"), "total": F.sum("held").over(group)})


def matched(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the table's columns of their partition and group; null groups match."""
    renamed = table.select(F.col("part").alias("_part"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[c for c in table.columns if c not in ("part", *by)])
    on = F.col("part") == F.col("_part")
    for i, c in enumerate(by):
        on = on & rows[c].eqNullSafe(renamed[f"_by{i}"])
    return rows.join(renamed, on).drop("_part", *[f"_by{i}" for i in range(len(by))])


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """rows with their number in their group, from 1."""
    s = placed(rows, by, order)
    table = small(starts(s, by, F.lit(1)).select(*by, "part", "first", "before"))
    return matched(s, table, by).withColumn(name, F.col("seen") - F.col("first") + F.col("before") + 1).drop("part", "seen", "first", "before")


def selected(counts: DataFrame, by: Sequence[str], value: str, n: str, percentiles: Sequence[float]) -> DataFrame:
    """by, percentile, value at rank floor((total - 1) * percentile / 100) of each group of (by, value, n: how often), values being distinct in a group.

    Only the partitions that hold a wanted rank are read again.
    """
    s = placed(counts, by, [value])
    table = starts(s, by, F.col(n)).withColumn("percentile", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    wanted = table.withColumn("rank", F.floor((F.col("total") - 1) * F.col("percentile") / 100) - F.col("before")).where("rank >= 0 AND rank < held")
    wanted = small(wanted.select(*by, "part", "percentile", "rank"))
    reached = s.join(F.broadcast(wanted.select("part").distinct()), "part", "left_semi")  # a row for each partition
    running = F.sum(n).over(Window.partitionBy("part", *by).orderBy(value))
    hits = matched(reached.withColumn("_to", running), wanted, by)
    return hits.where((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col(n))).select(*by, "percentile", F.col(value).alias("value"))


def running(rows: DataFrame, by: Sequence[str], order: str, amount: str) -> DataFrame:
    """by, order, level: the running sum of `amount` at each distinct order value, and next, the following one (null at a group's last)."""
    sums = rows.groupBy(*by, order).agg(F.sum(amount).alias("_sum"))
    s = placed(sums, by, [order])
    group = Window.partitionBy(*by).orderBy("part")
    table = starts(s, by, F.col("_sum")).select(*by, "part", "before")
    heads = s.groupBy(*by, "part").agg(F.min(order).alias("_head"))
    table = matched(table, heads, by).withColumn("_after", F.lead("_head").over(group)).drop("_head")
    within = Window.partitionBy("part", *by).orderBy(order)
    level = s.withColumns({"_level": F.sum("_sum").over(within), "_next": F.lead(order).over(within)})
    out = matched(level, small(table), by)
    return out.select(*by, order, (F.col("_level") + F.col("before")).alias("level"), F.coalesce("_next", "_after").alias("next"))
