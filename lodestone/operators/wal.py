"""A write-ahead log of row operations that any number of writers append to at once.

A writer first writes its rows as a segment, a Parquet folder of its own, sorted by their order; then it commits by putting a small file named after the first
sequence number behind the tail. If another writer has put one there, it reads that and tries behind it. So no commit is lost or halved, a segment without a
commit is as if never written, and a commit's cost does not grow with the log: the tail is found from the last commit that is known. A commit tells where each
partition of its segment starts, which gives each row its sequence number, first + offset + row, without writing it again.

Readers take the commits behind a number, read their segments alone and nothing of what lies before. truncate() drops what lies before.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Files

#: monotonically_increasing_id has the row of a partition in its lower 33 bits.
ROW_BITS = 33


@dataclass(frozen=True)
class Commit:
    first: int
    last: int
    segment: str
    starts: dict[str, int]


class Log:
    """A log in a folder; schema: the columns of its rows besides seq."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema, self.files = spark, path, schema, Files(spark)
        self.known: Commit | None = None

    def commit_path(self, first: int) -> str:
        return f"{self.path}/commits/{first:020d}.json"

    def commit_at(self, first: int) -> Commit | None:
        raw = self.files.read(self.commit_path(first))
        return None if raw is None else Commit(**json.loads(raw))

    def commits(self, after: int = -1) -> list[Commit]:
        """The commits behind `after`, the number of a checkpoint, in order: found one from the other, never by a list of all."""
        out, at = [], after + 1
        while (c := self.commit_at(at)) is not None:
            out.append(c)
            at = c.last + 1
        if out:
            self.known = out[-1]
        return out

    def last(self, after: int = -1) -> int:
        """The last sequence number."""
        if self.known is None or self.known.last < after:
            found = self.commits(after)
            return found[-1].last if found else after
        while (c := self.commit_at(self.known.last + 1)) is not None:
            self.known = c
        return self.known.last

    def append(self, rows: DataFrame, order: Column, after: int = -1) -> tuple[int, int] | None:
        """Append rows in that order, as one commit behind the tail and behind `after`; the first and last sequence number, None without rows."""
        segment = uuid.uuid4().hex
        path = f"{self.path}/segments/{segment}"
        sorted_rows = rows.withColumn("_order", order).repartitionByRange(F.col("_order")).sortWithinPartitions("_order").drop("_order")
        sorted_rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)}).write.parquet(path)
        held = self.spark.read.parquet(path).groupBy("_part").count().orderBy("_part").collect()  # a row for each partition
        starts, n = {}, 0
        for r in held:
            starts[str(r["_part"])] = n
            n += r["count"]
        if not n:
            self.files.delete(path)
            return None
        while True:
            first = self.last(after) + 1
            commit = Commit(first, first + n - 1, segment, starts)
            if self.files.put(self.commit_path(first), json.dumps(commit.__dict__)):
                self.known = commit
                return first, commit.last

    def read(self, after: int = -1) -> DataFrame | None:
        """The rows behind `after` with their seq; None if there are none. Only their segments are read."""
        commits = self.commits(after)
        if not commits:
            return None
        starts = self.spark.createDataFrame([(c.segment, int(p), c.first + n) for c in commits for p, n in c.starts.items()], "_segment string, _part int, _first long")
        rows = self.spark.read.schema(f"{self.schema}, _part int, _row long").parquet(*[f"{self.path}/segments/{c.segment}" for c in commits])
        rows = rows.withColumn("_segment", F.regexp_extract(F.col("_metadata.file_path"), "segments/([0-9a-f]{32})/", 1))
        numbered = rows.join(F.broadcast(starts), ["_segment", "_part"])  # a row for each partition of the segments that are read
        return numbered.withColumn("seq", F.col("_first") + F.col("_row")).drop("_segment", "_part", "_row", "_first")

    def truncate(self, upto: int, after: int = -1, grace: float = 0.0) -> int:
        """Drop the segments of commits behind `after` that end at `upto` or before; their number. Commit files stay for `grace` seconds, so that a writer
        who is about to commit still meets them; the one that ends at `upto` stays always."""
        done = [c for c in self.commits(after) if c.last <= upto]
        for c in done:
            self.files.delete(f"{self.path}/segments/{c.segment}")
        for name, age in self.files.names(f"{self.path}/commits").items():
            if age >= grace and int(name.removesuffix(".json")) < (done[-1].first if done else 0):
                self.files.delete(f"{self.path}/commits/{name}")
        return len(done)

    def drop_orphans(self, after: int = -1, grace: float = 0.0) -> int:
        """Remove the segments that no commit behind `after` names, left by writers that died, if they are older than `grace` seconds; their number."""
        used = {c.segment for c in self.commits(after)}
        gone = [n for n, age in self.files.names(f"{self.path}/segments").items() if n not in used and age >= grace]
        for n in gone:
            self.files.delete(f"{self.path}/segments/{n}")
        return len(gone)

    def statistics(self, after: int = -1) -> dict:
        """Segments, rows and bytes behind `after`, and the first and last sequence number."""
        commits = self.commits(after)
        size = sum(self.files.size(f"{self.path}/segments/{c.segment}") for c in commits)
        rows = sum(c.last - c.first + 1 for c in commits)
        return {"segments": len(commits), "rows": rows, "bytes": size, "first": commits[0].first if commits else None, "last": commits[-1].last if commits else after}


def latest(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key: max_by over the order keeps one row a key on the map side, so a key with most rows is no hot group."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def numbered_by(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with a number that grows with `order`, by a range sort; numbers are not gapless."""
    return rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn(name, F.monotonically_increasing_id())


