"""What completes the SimHash near-dedup to a likeness of word shingles: links that differ in too many bits for the index of the fingerprints' bytes.

Texts with the same set of shingles are one class. Pairs of classes that simhash.links() finds are candidates like others. Shingles have a global order, those common in a sample of texts last, which decides what the work costs
and not what is found. Two sets of likeness t share one of the first n - ceil(t n) + 1 of each, so all pairs of each posting list of these are candidates.
Sets are first compared by sketches, parities of shingle counts in buckets: they differ in no more bits than the sets differ in shingles, so no pair is
lost. What remains is verified by the sets themselves.

First come the fingerprints' pairs, and each member of a list with three leaders of the list, the same ones in most lists of a group; then, in lists that
still hold several groups, all pairs that are not in one group yet are compared, long lists by pairs of blocks, so that a large group of copies brings no
link for each of its pairs. Shingles and classes are known by 64-bit hashes.

Defined results: null and empty texts are one class without shingles; of rows with equal id and text one stays, that of the least hash of its other columns; rows with
a null id come last; empty tables give no rows; all columns of docs are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, staged
from .simhash import bits_set, components, links, row_key

#: Bits of the filter by which texts to read again are chosen; others that it lets through are joined away.
FILTER = 1 << 24


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes. Words are runs without ASCII white space, lower-cased in A-Z; fewer words than `size` are one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, lengths, digest = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)), xxhash.xxh64_intdigest
    end = np.cumsum(lengths + 1) - 1
    k = min(size, len(words))
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip((end - lengths)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in a power of two of buckets, between twice and four times as many as shingles, 64 at least."""
    m = max(64, 1 << max(2 * len(s) - 1, 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer folded to the length of the shorter."""
    if len(a) > len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = y >> bits ^ y & (1 << bits) - 1
    return (x ^ y).bit_count()


def prefix(s: np.ndarray, likeness: float, common: np.ndarray) -> np.ndarray:
    if not len(s):
        return s
    late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
    return np.concatenate([s[~late], s[late]])[: len(s) - int(np.ceil(likeness * len(s) - 1e-9)) + 1]


def near(n: np.ndarray | int, m: np.ndarray | int, likeness: float) -> np.ndarray | float:
    """The most shingles in which sets of n and m may differ."""
    return (n + m) * (1 - likeness) / (1 + likeness) + 1e-6


def common_shingles(docs: DataFrame, size: int, text_col: str, texts: int = 10_000, most: int = 100_000) -> np.ndarray:
    """Shingles that at least three of about `texts` sampled distinct texts hold, at most `most`; they only order the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), size).view(np.int64))], names=["s"])

    every = max(1, docs.count() // texts)
    chosen = docs.select(F.col(text_col).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).distinct()
    counts = chosen.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 2")
    return np.sort(np.array([r[0] for r in counts.orderBy(F.desc("n"), "s").limit(most).collect()], np.int64).view(np.uint64))


def classes_of(docs: DataFrame, size: int, likeness: float, id_col: str, text_col: str) -> DataFrame:
    """c, n, sketch, prefix and fingerprint (fp) of each distinct set of shingles, and k, the least key of its rows."""
    import xxhash

    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, n, bits, first, fp = [], [], [], [], []
            for t in b.column(3):
                s = shingles(t.as_py(), size)
                c.append(xxhash.xxh64_intdigest(s.tobytes(), 1))
                n.append(len(s))
                bits.append(sketch(s))
                first.append(prefix(s, likeness, common.value).view(np.int64))
                fp.append(np.packbits(2 * bits_set(s) > len(s)).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.array(c, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(fp, pa.binary())], names=["k0", "k1", "k2", "c", "n", "sketch", "prefix", "fp"])

    rows = docs.select(*row_key(id_col, text_col), F.col(text_col)).mapInArrow(run, "k0 boolean, k1 long, k2 long, c long, n int, sketch binary, prefix array<long>, fp binary")
    return staged(rows.groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"), F.first("fp").alias("fp"), F.min(F.struct("k0", "k1", "k2")).alias("k")))


def posting_lists(classes: DataFrame, block: int) -> DataFrame:
    """Rows of the posting lists of two members at least: key, c, n, root (c itself yet), shared (lists that hold c), block (of members in order of size) and blocks."""
    own = Window.partitionBy("key")
    posts = classes.select(F.explode("prefix").alias("key"), "c", "n")
    at = (F.row_number().over(own.orderBy("n", "c")) - 1) / block
    rows = posts.select("key", "c", "n", F.count("*").over(own).alias("size"), at.cast("int").alias("block"))
    return staged(rows.where("size > 1").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).drop("size").withColumn("root", F.col("c")).withColumn("shared", F.count("*").over(Window.partitionBy("c"))))


def of_several(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose members are of several roots, with these."""
    own = Window.partitionBy("key")
    named = lists.drop("root").join(roots, lists.c == roots.node, "left").withColumn("root", F.coalesce("root", "c")).drop("node")
    return staged(named.withColumn("least", F.min("root").over(own)).withColumn("most", F.max("root").over(own)).where("least <> most").drop("least", "most"))


def fingerprint_pairs(classes: DataFrame, likeness: float) -> DataFrame:
    """Pairs (a, b) of classes whose fingerprints the byte index links, one class standing for all of a fingerprint, and of those with the class that stands for them."""
    own = classes.groupBy("fp").agg(F.min("c").alias("m"))
    same = classes.join(own, "fp").where("c <> m").select(F.col("m").alias("a"), F.col("c").alias("b"))
    met = links(own, 2)
    other = met.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    sizes = classes.select("c", "n")
    both = same.unionByName(other).join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b")
    return both.where(F.least("n", "m") >= likeness * F.greatest("n", "m") - 1e-6).select("a", "b")


def led(lists: DataFrame, classes: DataFrame, likeness: float) -> DataFrame:
    """Pairs (a, b) of different roots, of members and leaders of lists, that may be alike enough by their sizes.

    The leaders are the members of the least and the greatest hash, and that whose prefix shares most: of texts that edits of one made, the one without edits."""
    own = Window.partitionBy("key")
    by_hash = F.struct(F.xxhash64("c").alias("h"), "c", "n", "root")
    by_shared = F.max(F.struct("shared", by_hash.alias("of"))).over(own)["of"]
    rows = lists.select("c", "n", "root", F.array(F.min(by_hash).over(own), F.max(by_hash).over(own), by_shared).alias("leaders"))
    pairs = rows.select("c", "n", "root", F.explode("leaders").alias("l")).where("root <> l.root").where(F.least("n", "l.n") >= likeness * F.greatest("n", "l.n") - 1e-6)
    return pairs.select(F.least("c", "l.c").alias("a"), F.greatest("c", "l.c").alias("b")).distinct()


def sketched(pairs: DataFrame, classes: DataFrame, likeness: float) -> DataFrame:
    """The pairs that sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, x, y = (b.column(i).to_pylist() for i in range(2, 6))
            ok = [differing(p, q) <= near(i, j, likeness) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    own = classes.select("c", "n", "sketch")
    both = pairs.join(own.toDF("a", "n", "x"), "a").join(own.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    return staged(both.mapInArrow(run, "a long, b long"))


def compared(c: np.ndarray, n: np.ndarray, root: np.ndarray, block: np.ndarray, bits: list[bytes], likeness: float) -> Iterator[tuple[int, int]]:
    """Pairs of different roots that sketches don't rule out, of members in order of n; of two blocks' members those from different blocks."""
    two = block.min() != block.max()
    if len(c) <= 16:
        for i, j in combinations(range(len(c)), 2):
            if root[i] != root[j] and not (two and block[i] == block[j]) and n[i] >= likeness * n[j] - 1e-6 and differing(bits[i], bits[j]) <= near(n[i], n[j], likeness):
                yield c[i], c[j]
        return
    length = np.array([len(x) for x in bits])
    wide = {w: np.frombuffer(b"".join(x for x in bits if len(x) == w), np.uint8).reshape(-1, w) for w in set(length.tolist())}
    start = {w: int(np.searchsorted(length, w)) for w in wide}
    folded = {w: m[:, : w // 2] ^ m[:, w // 2 :] for w, m in wide.items()}
    last = np.searchsorted(n, (n + 1e-6) / likeness, "right")
    for i in range(len(c)):
        w = int(length[i])
        own = wide[w][i - start[w]]
        for v, m in ((w, wide[w]), (2 * w, folded.get(2 * w))):  # a set of at most 1.25 times the size has a sketch of at most twice the length
            if m is None:
                continue
            lo, hi = max(i + 1, start[v]), min(int(last[i]), start[v] + len(m))
            if lo >= hi:
                continue
            at = np.arange(lo, hi)
            at = at[(root[lo:hi] != root[i]) & ~(two & (block[lo:hi] == block[i]))]
            if len(at):
                near_by = np.bitwise_count(m[at - start[v]] ^ own).sum(1) <= near(n[at], n[i], likeness)
                yield from ((c[i], c[j]) for j in at[near_by].tolist())


def unled(lists: DataFrame, classes: DataFrame, likeness: float) -> DataFrame:
    """All pairs (a, b) of lists that are of different roots and that sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, out = None, set()
        for b in batches:
            t = pa.Table.from_batches([b] if kept is None else [kept, b]).combine_chunks()
            if not t.num_rows:
                continue
            g = np.stack([t.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((g[:, 1:] != g[:, :-1]).any(0)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            kept = t.slice(done).combine_chunks().to_batches()[0]
            out.update(pairs(t.slice(0, done), np.concatenate([[0], cuts]).astype(int)))
            if len(out) > 10_000:
                yield batch(out)
                out = set()
        if kept is not None:
            out.update(pairs(pa.Table.from_batches([kept]), np.array([0, kept.num_rows])))
        yield batch(out)

    def pairs(t: pa.Table, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
        c, n, root, block = (t.column(x).to_numpy() for x in ("c", "n", "root", "block"))
        bits = t.column("sketch").to_pylist()
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if j - i > 1:
                yield from ((int(min(p)), int(max(p))) for p in compared(c[i:j], n[i:j], root[i:j], block[i:j], bits[i:j], likeness))

    def batch(found: set) -> pa.RecordBatch:
        xs = list(found)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in xs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = lists.join(classes.select("c", "sketch"), "c").select("key", "c", "n", "root", "block", "sketch", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "c", "n", "root", "block", "sketch")
    return staged(rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "c").mapInArrow(run, "a long, b long").distinct())


def alike(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, likeness: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose sets of shingles have the likeness."""
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes.select("c", "k"), "c").select("c", "k.*"))
    place = ids.select((F.pmod("k2", F.lit(FILTER)) + 1).alias("at"))
    built = place.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(FILTER // 8, np.uint8)  # 2 MB, of which each bucket has 4096 bytes
    for r in built:
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    wanted = docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy() % FILTER
            b = b.filter(pa.array((wanted.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([shingles(t.as_py(), size).tobytes() for t in b.column(3)], pa.binary())], names=["k0", "k1", "k2", "s"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                ok.append(len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) <= near(len(x), len(y), likeness))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    texts = docs.select(*row_key(id_col, text_col), F.col(text_col)).mapInArrow(read, "k0 boolean, k1 long, k2 long, s binary")
    sets = staged(texts.join(ids, ["k0", "k1", "k2"]).dropDuplicates(["c"]).select("c", "s"))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return staged(both.mapInArrow(verify, "a long, b long"))


def representatives(docs: DataFrame, shingle: int = 5, likeness: float = 0.8, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one stays for each group that links of the likeness connect: that with the least id."""
    classes = classes_of(docs, shingle, likeness, id_col, text_col)
    lists = posting_lists(classes, block)
    verified = lambda pairs: alike(pairs, classes, docs, shingle, likeness, id_col, text_col)
    met = sketched(led(lists, classes, likeness).unionByName(fingerprint_pairs(classes, likeness)).distinct(), classes, likeness)
    found = verified(met)
    rest = staged(unled(of_several(lists, components(found)), classes, likeness).join(met, ["a", "b"], "left_anti"))
    roots = components(found.unionByName(verified(rest)))
    least = classes.join(roots, classes.c == roots.node, "left").groupBy(F.coalesce("root", "c").alias("root")).agg(F.min("k").alias("k")).select("k.*")
    names = fresh(docs, "k0", "k1", "k2")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(*[c.alias(n) for c, n in zip(row_key(id_col, text_col), names, strict=True)], row.alias("_row"))
    once = keyed.groupBy(*names).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))  # before the shuffle too, so a row repeated very often moves once a partition
    kept = once.join(least.toDF(*names), names, "left_semi")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
