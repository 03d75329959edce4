"""SimHash near-dedup by an inverted index over the bytes of the fingerprints.

A fingerprint bit is 1 if it is set in over half the hashes of a document's word shingles. Distinct fingerprints are posted under positional bytes; as lists of a
single byte would be long, they are split by further bytes from the start: a list holds the fingerprints that agree in a set of positions, of `start` positions at
first. For each pair that meets in lists of `posting` members at most, the positions of all its lists are united: that is the tally of the bytes it shares. A
longer list is split by each further position into lists of its own, whatever its length, so the tally stays whole. With 8 bytes and at most 2 differing bits
at least 6 bytes match; pairs with a lower tally go, and the differing bits of the others are counted. Where 6 bytes agree and a list is still longer, its
members (65,536 at most) all share what the tally asks for: they are not paired, but looked up by the two bytes that are left, with up to two bits flipped.
Links are contracted to components by alternating star steps, each written to the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like others; repeated rows share a component; rows with a null id are linked, and
a component of such rows alone has a null id; empty tables give no rows; other columns are kept aside.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, release, staged


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> bytes:
    """8 bytes, most significant first. Words are runs without ASCII white space, lower-cased in A-Z."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return bytes(8)
    joined, size, digest = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)), xxhash.xxh64_intdigest
    end = np.cumsum(size + 1) - 1
    k, ones = min(shingle, len(words)), np.zeros(64, np.int64)
    begin, stop = (end - size)[: len(words) - k + 1], end[k - 1 :]
    for at in range(0, len(begin), 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(begin[at : at + (1 << 16)].tolist(), stop[at : at + (1 << 16)].tolist(), strict=True)], np.uint64)
        ones += bits_set(h)
    return np.packbits(2 * ones > len(begin)).tobytes()


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of the 64 bits, the most significant first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def row_key(id_col: str, text_col: str) -> list:
    """What tells rows apart: id (nulls last) and text; rows repeated whole are one."""
    return [F.col(id_col).isNull().alias("k0"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"), F.xxhash64(F.col(text_col).isNull(), text_col).alias("k2")]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row key (k0, k1, k2), doc_id and fingerprint (fp, binary) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([fingerprint(x.as_py(), shingle) for x in b.column(4)], pa.binary())], names=["k0", "k1", "k2", "doc_id", "fp"])

    return docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "k0 boolean, k1 long, k2 long, doc_id long, fp binary")


BYTES = 8
#: A list's key: the number of its set of positions in these bits and above, below them its bytes, the first position's lowest.
KEY_BITS = 56
LINK = "a long, b long"
#: As many keys with their counts at most (16 bytes each) are broadcast.
SMALL = 1_000_000


def position_sets(size: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(BYTES), size))


def keys(fp: Column, size: int) -> Column:
    """The keys of a fingerprint (a long) under all sets of so many positions, by number of the set."""
    byte = lambda p: F.shiftright(fp, 8 * (BYTES - 1 - p)).bitwiseAND(255)
    return F.array(*[sum((F.shiftleft(byte(p), 8 * i) for i, p in enumerate(some)), F.lit(j << KEY_BITS)) for j, some in enumerate(position_sets(size))])


def by_set(values: list) -> Callable[[Column], Column]:
    """Looks up a value by the number of a set."""
    return lambda number: F.get(F.array(*[F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values]), number)


def met(fps: DataFrame, deepest: int, start: int, posting: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, mask): pairs of fingerprints (longs, column fp), for each list of `posting` members at most in which they meet, with the list's positions as bits;
    and (members): the lists of `deepest` positions that are longer."""
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few bytes become dozens of rows, so many tasks share them
    own, pairs = fps.repartition(tasks).select("fp", F.explode(keys(F.col("fp"), start)).alias("key")), None
    for size in range(start, deepest + 1):
        sets = position_sets(size)
        number = F.shiftright("key", KEY_BITS).cast("int")
        mask = by_set([sum(1 << p for p in some) for some in sets])(number).cast("long").alias("mask")
        lists = staged(own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
        wanted = lists.where("n > 2").select("key", "n")
        members = staged(own.join(F.broadcast(wanted) if wanted.count() <= SMALL else wanted, "key"))
        short = members.where(F.col("n") <= posting).select("key", "fp")
        some = lists.where("n = 2").select("a", "b", "key").unionByName(short.withColumnRenamed("fp", "a").join(short.withColumnRenamed("fp", "b"), "key").where("a < b").select("a", "b", "key"))
        pairs = some.select("a", "b", mask) if pairs is None else pairs.unionByName(some.select("a", "b", mask))
        long = members.where(F.col("n") > posting)
        if size == deepest or long.isEmpty():
            break
        place = {s: i for i, s in enumerate(position_sets(size + 1))}
        wider = by_set([[place[tuple(sorted((*some, p)))] for p in range(BYTES) if p not in some] for some in sets])
        split = long.select("fp", F.explode(wider(number)).alias("number")).distinct()
        own = staged(split.select("fp", F.get(keys(F.col("fp"), size + 1), F.col("number")).alias("key")))
    return pairs, long.groupBy("key").agg(F.collect_set("fp").alias("members")).select("members")


def tallied(pairs: DataFrame, matches: int) -> DataFrame:
    """(a, b, tally) of the pairs that share at least so many positional bytes, counted over all lists in which they meet."""
    return pairs.groupBy("a", "b").agg(F.bit_count(F.bit_or("mask")).alias("tally")).where(F.col("tally") >= matches)


def links(fps: DataFrame, radius: int, start: int = 3, posting: int = 16) -> DataFrame:
    """Links (a, b) between distinct 8-byte fingerprints (column fp, binary) that differ in at most `radius` (1 or 2) bits: all of them, but of the members of a
    list that agree in all but `radius` bytes and are more than `posting` as many as connect what all of them connect."""
    numbers = staged(fps.select(F.conv(F.hex("fp"), 16, -10).cast("long").alias("fp")))
    pairs, long = met(numbers, BYTES - radius, start, posting)
    near = tallied(pairs, BYTES - radius).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    found = near.unionByName(long.mapInArrow(looked_up(radius), LINK).distinct())
    binary = lambda c: F.unhex(F.lpad(F.hex(c), 2 * BYTES, "0")).alias(c)
    return found.select(binary("a"), binary("b"))


def looked_up(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From lists of fingerprints that agree in all but `radius` bytes, links that connect what is within `radius` bits. Each looks up the numbers that differ
    in so few bits from that of its free bytes; the least reached so far is handed on until nothing changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [sum(1 << i for i in c) for k in range(1, radius + 1) for c in itertools.combinations(range(8 * radius), k)]
        for b in batches:
            for members in b.column(0).to_pylist():
                members.sort()
                m = np.array(members, np.int64).astype(">i8").view(np.uint8).reshape(-1, BYTES)
                free = np.flatnonzero((m != m[0]).any(0))  # at most radius bytes; those beside them are alike
                value = np.zeros(len(m), np.int64)
                for i in free:
                    value = value << 8 | m[:, i]
                place = np.full(1 << 8 * radius, -1)
                place[value] = np.arange(len(m))
                pairs = []
                for f in flips:
                    if f < 1 << 8 * len(free):
                        other = place[value ^ f]
                        at = np.flatnonzero(other >= 0)
                        pairs.append((at, other[at]))
                least, before = np.arange(len(m)), None
                while before is None or (least != before).any():
                    before = least.copy()
                    for x, y in pairs:
                        np.minimum.at(least, x, least[y])
                    least = least[least]
                at = np.flatnonzero(least != np.arange(len(m)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([members[i] for i in some.tolist()], pa.int64()) for some in (least[at], at)], names=["a", "b"])

    return run


def rooted(classes: DataFrame, reach: DataFrame) -> DataFrame:
    return classes.join(reach, classes.fp == reach.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node that it reaches) for the nodes of the edges (a, b), by alternating large-star and small-star steps. Nodes with very many edges
    meet these by broadcast."""
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen, size = None, e.count()
    for _ in range(rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges")).withColumn("m", F.least("u", "m")))
        large = joined_by_key(both.where("v > u"), least, ["u"], "edges", 2 * size).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").union(low.select("u", "m")).toDF("u", "v").distinct()
        after = staged(small)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(e)
        release(least)
        e, size = after, now[0]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.toDF("node", "root").union(e.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, posting: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the least doc_id that links reach.

    shingle: words of a shingle; radius: bits that linked fingerprints may differ in, 1 or 2; no link is lost. posting: members up to which a list is paired before it
    is split by further bytes.
    """
    f = staged(fingerprints(docs, shingle, id_col, text_col))
    classes = f.select("fp").distinct()
    roots = rooted(classes, components(links(classes, radius, posting=posting)))
    firsts = f.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, "fp")
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = firsts.join(least, "root").select("fp", "component_id")
    return f.join(named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 5, likeness: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one stays, that with the least id, for each group that links connect: pairs whose sets of shingles have the likeness.

    Pairs found by the fingerprints are verified by their shingles. Fingerprints of texts of likeness 0.8 differ in about 10 of 64 bits, for which no byte need
    match, so near_copies completes the links by the shingles themselves; null and empty texts are one group, rows repeated whole are one row.
    """
    from . import near_copies  # takes this module's index and components

    return near_copies.representatives(docs, shingle, likeness, id_col=id_col, text_col=text_col)
