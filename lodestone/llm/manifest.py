"""Merkle manifest of a dataset: one tree for each group of rows, one above their roots, and for each row the siblings that prove it.

Rows are numbered within their group by a range sort with counts per partition, so no task sees a whole group. The numbered leaves fall into aligned
blocks of 2**height. A block's authentication paths come from fractal traversal: for each of height / step levels the existing subtree and the desired
one, which a stack of unfinished nodes builds two steps a leaf ahead of its use, so a block needs its leaves and about 2**(step + 1) nodes a level. The
blocks' roots are the leaves of the next tree above, solved in the same way, until one node a group is left; a group's roots are in the end the leaves of
one tree. Each row's upper siblings are joined from its block's.

A node is the hash of its one or two children's digests as hex text, the left first. A path holds a text for each level: `L` or `R` with the digest of the
sibling to the left or right, or empty where a node stands alone.

Defined results: a null field is written `-`, so null and empty differ; a null group is a group of its own and the first; a null order value is the least;
equal order values are ordered by leaf, and repeated rows are leaves each, next to one another; an empty table gives no rows; a row alone in its group is its
own subroot, with the siblings of the upper tree only; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_by_key, staged

#: A table of as many short rows at most is broadcast.
SMALL = 100_000
SOLVED = "tree binary, block long, at long, path array<string>, top string"
SOLVED_ARROW = pa.schema([("tree", pa.binary()), ("block", pa.int64()), ("at", pa.int64()), ("path", pa.list_(pa.string())), ("top", pa.string())])


def field(c: Column) -> Column:
    """A value as its UTF-8 length, a colon and itself; null as a dash."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def joined(left: str | None, right: str | None) -> str | None:
    """The node above one or two siblings; none above none."""
    return None if left is None else hashlib.sha256((left + (right or "")).encode()).hexdigest()


class Subtree:
    """The nodes from `low` to below `high` levels of one subtree of that height, filled leaf by leaf through a stack of unfinished nodes."""

    def __init__(self, low: int, high: int, number: int):
        self.low, self.high, self.next, self.end = low, high, number << high, (number + 1) << high
        self.kept: dict[tuple[int, int], str | None] = {}
        self.stack: list[tuple[int, int, str | None]] = []

    def step(self, leaves: list[str]) -> None:
        """One leaf or one joining of the two uppermost nodes of the stack."""
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (level, _, right), (_, at, left) = stack.pop(), stack.pop()
            node = (level + 1, at >> 1, joined(left, right))
        elif self.next < self.end:
            node = (0, self.next, leaves[self.next] if self.next < len(leaves) else None)
            self.next += 1
        else:
            return
        stack.append(node)
        if self.low <= node[0] < self.high:
            self.kept[node[:2]] = node[2]

    def filled(self, leaves: list[str]) -> Subtree:
        while not self.stack or self.stack[0][0] < self.high:
            self.step(leaves)
        return self


def paths(leaves: list[str], height: int, step: int = 3) -> Iterator[list[str]]:
    """Each leaf's siblings from the lowest level up, in a block of 2**height leaves of which the last may be absent."""
    cuts = [(k, min(k + step, height)) for k in range(0, height, step)]
    existing = [Subtree(low, high, 0).filled(leaves) for low, high in cuts]
    desired = [Subtree(low, high, 1) for low, high in cuts[:-1]]
    for at in range(len(leaves)):
        for k, ahead in enumerate(desired):
            if at and not at & ((1 << ahead.high) - 1):  # the traversal leaves this level's subtree
                existing[k] = ahead = ahead.filled(leaves)
                desired[k] = Subtree(ahead.low, ahead.high, (at >> ahead.high) + 1)
        out = []
        for (low, high), tree in zip(cuts, existing, strict=True):
            for level in range(low, high):
                beside = tree.kept[level, (at >> level) ^ 1]
                out.append("" if beside is None else ("L" if at >> level & 1 else "R") + beside)
        yield out
        for ahead in desired:
            ahead.step(leaves)
            ahead.step(leaves)


def top_of(leaf: str, path: list[str]) -> str:
    for s in path:
        leaf = joined(s[1:], leaf) if s[:1] == "L" else joined(leaf, s[1:])
    return leaf


def height_of(n: int) -> int:
    return max(n - 1, 0).bit_length()


def solver(height: int):
    def solve(key: tuple, block: pa.Table) -> pa.Table:
        """A block's paths and its root. A block that is a whole tree ends where one node is left."""
        block = block.sort_by("at")
        leaves, n = block.column("digest").to_pylist(), block.column("n")[0].as_py()
        tall = height if n > 1 << height else height_of(n)
        found = list(paths(leaves, tall))
        top = top_of(leaves[0], found[0])
        return pa.table([block.column("tree"), pa.array([key[1].as_py()] * len(leaves), pa.int64()), block.column("at"), pa.array(found, pa.list_(pa.string())), pa.array([top] * len(leaves))], schema=SOLVED_ARROW)

    return solve


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (with tree), each with its number `at` in its tree (from 0, by order) and the tree's size n; written once.

    A range sort numbers the rows of each partition; a tree's first row and count in each partition, at most partitions + trees rows, give the rest.
    """
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows of any number spread over partitions
    keys = [F.col("tree"), *order, F.col("salt")]
    ranged = salted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = staged(ranged.drop("salt").withColumns({"part": F.spark_partition_id(), "seen": F.monotonically_increasing_id()}))
    held = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("held"), F.min("seen").alias("first"))
    tree = Window.partitionBy("tree")
    start = staged(held.select("tree", "part", (F.sum("held").over(tree.orderBy("part")) - F.col("held") - F.col("first")).alias("shift"), F.sum("held").over(tree).alias("n")))
    if start.count() <= SMALL:
        start = F.broadcast(start)
    return staged(ranged.join(start, ["tree", "part"]).withColumn("at", F.col("seen") + F.col("shift")).drop("part", "seen", "shift"))


def solved(nodes: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """(tree, at, path) of every node of (tree, at, digest, n), and (tree, root, n) of every tree."""
    levels, most = [], nodes.agg(F.max("n")).first()[0] or 0
    sizes = nodes.where(F.col("at") == 0).select("tree", "n")
    while True:
        blocks = nodes.withColumn("block", F.shiftright("at", height)).groupBy("tree", "block")
        levels.append(staged(blocks.applyInArrow(solver(height), SOLVED)))
        tops = levels[-1].where(F.col("at") == F.shiftleft("block", height)).select("tree", F.col("block").alias("at"), F.col("top").alias("digest"))
        if most <= 1 << height:
            break
        most = -(-most >> height)
        nodes = tops.join(tops.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "tree")
    out = levels.pop().select("tree", "at", "path")
    for level in reversed(levels):
        upper = out.select("tree", F.col("at").alias("block"), F.col("path").alias("upper"))
        out = level.join(upper, ["tree", "block"]).select("tree", "at", F.concat("path", "upper").alias("path"))
    return out, tops.join(sizes, "tree").select("tree", F.col("digest").alias("root"), "n")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    beside = lambda s: F.substring(s, 2, 64)
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.when(s.startswith("L"), F.concat(beside(s), node)).otherwise(F.concat(node, beside(s))).cast("binary"), 256))


def digest_of(path: Column) -> Column:
    """One digest of all siblings, in their order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)


def prove(rows: DataFrame, leaf: Column, group: Column, order: Column, keep: list[Column], height: int = 10) -> DataFrame:
    """The columns `keep` of every row, then leaf, subroot, root, and path: its siblings, through its group's root to the root of all.

    Groups are ordered as UTF-8 text, null first; rows within a group by `order`.
    """
    tree = F.coalesce(F.concat(F.unhex(F.lit("01")), group.cast("string").cast("binary")), F.unhex(F.lit("00")))
    given = staged(rows.select(F.struct(*keep).alias("row"), tree.alias("tree"), order.alias("key"), leaf.alias("digest")))
    placed = numbered(given, [F.col("key").asc_nulls_first(), F.col("digest")])
    inner, roots = solved(placed.select("tree", "at", "digest", "n"), height)
    named = roots.select(F.unhex(F.lit("")).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"), F.col("n").alias("rows"))
    groups = numbered(named, [F.col("name")])
    outer, whole = solved(groups.select("tree", "at", "digest", "n"), height)
    top = groups.join(outer, ["tree", "at"]).join(whole.select("tree", "root"), "tree")
    top = staged(top.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("path").alias("upper"), "rows"))
    found = joined_by_key(placed.join(inner, ["tree", "at"]), top, ["tree"], "rows", top.agg(F.sum("rows")).first()[0] or 0)
    return found.select("row.*", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "upper").alias("path"))
