"""Neighbour graphs and low-dimensional projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ProjectionError
from ..functions.vectors import Metric
from ..models import Embedder, embed
from ..plans.config import ProjectionConfig
from ..sources.shared import Files, shared_folder, written
from . import ranks
from . import search as S


def knn_graph(rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """src, dst, distance, weight: the k nearest others of each vector, with weight exp(-distance / sigma), sigma the upper median of the vector's distances (1e-6 at least)."""
    hits = S.knn(rows, rows, k, Metric.EUCLIDEAN, skip_self=True, id_col=id_col, vector_col=vector_col).withColumn("d", F.sqrt("distance"))
    n = F.count("*").over(Window.partitionBy("query_id"))
    sigma = F.greatest(F.lit(1e-6), F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2) + 1, F.col("d"))).over(Window.partitionBy("query_id")))
    return hits.withColumn("n", n).withColumn("sigma", sigma).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("d").alias("distance"), F.exp(-F.col("d") / F.col("sigma")).alias("weight"))


EDGES = "src long, dst long, d double"


def met(groups: DataFrame, keys: list[str], pool: int) -> DataFrame:
    """src, dst, d: of each group's members (id, v, and far: the squared distance up to which it wants to know others) the `pool` nearest others of the group.

    A group is some thousand vectors, compared in tiles.
    """

    def meet(group: pa.Table) -> pa.Table:
        ids, first = np.unique(group.column("id").to_numpy(), return_index=True)
        far = group.column("far").to_numpy()[first]
        x = S.matrix(group.column("v"))[first]
        return pa.table(dict(zip(("src", "dst", "d"), S.nearest(ids, x, ids, x, Metric.EUCLIDEAN, pool, True, far), strict=True)))

    return groups.select(*keys, "id", "v", "far").groupBy(*keys).applyInArrow(meet, EDGES)


#: Pairs of a small group's members that are held at once, about: 16 MB of doubles.
HELD_PAIRS = 2 << 20


def pairs_within(mids: np.ndarray, ids: np.ndarray, x: np.ndarray, far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """src, dst, d of the members (in order of mid and id) of each mid that are no farther than src wants to know; many small groups in one matrix product."""
    new = np.ones(len(ids), bool)
    new[1:] = (mids[1:] != mids[:-1]) | (ids[1:] != ids[:-1])
    mids, ids, x, far = mids[new], ids[new], x[new], far[new]
    first = np.flatnonzero(np.append(True, mids[1:] != mids[:-1]))
    sizes = np.diff(np.append(first, len(mids)))
    order, at = np.argsort(sizes, kind="stable")[::-1], 0  # those of about one size together
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (x * x).sum(1)
        while at < len(order):
            wide = sizes[order[at]]
            some = order[at : (at := at + max(1, HELD_PAIRS // int(wide * max(wide, x.shape[1]))))]
            held = np.arange(wide) < sizes[some][:, None]
            rows = np.where(held, first[some][:, None] + np.arange(wide), 0)
            v, s = x[rows], squares[rows]
            d = v @ v.transpose(0, 2, 1)
            d *= -2
            d += s[:, :, None]
            d += s[:, None, :]
            limit = np.where(held, far[rows] + 1e-14 * (x.shape[1] + 16) * (s + s.max(1, keepdims=True)), -np.inf)
            near = ~(d > limit[:, :, None])  # what overflows is settled below
            near &= held[:, None, :]
            near[:, np.arange(wide), np.arange(wide)] = False
            g, r = np.divmod(np.flatnonzero(near), wide * wide)
            i, j = rows[g, r // wide], rows[g, r % wide]
            for piece in range(0, len(i), S.TILE_ROWS):
                a, b = i[piece : piece + S.TILE_ROWS], j[piece : piece + S.TILE_ROWS]
                exact = ((x[b] - x[a]) ** 2).sum(1)
                wanted = exact <= far[a]
                yield ids[a[wanted]], ids[b[wanted]], exact[wanted]


def met_around(around: DataFrame) -> DataFrame:
    """src, dst, d: of those that stand around one node (mid, id, v, far), the pairs that src wants to know. A node has a few dozen or hundred around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows).combine_chunks()
            if t.num_rows:
                found = list(pairs_within(t.column("mid").to_numpy(), t.column("id").to_numpy(), S.matrix(t.column("v")), t.column("far").to_numpy()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["src", "dst", "d"])

        waiting: list[pa.RecordBatch] = []  # of one node, which may go on in the next batch
        for b in batches:
            if b.num_rows:
                mids = b.column("mid").to_numpy()
                cut = int(np.searchsorted(mids, mids[-1]))
                if cut or waiting and waiting[-1].column("mid")[0].as_py() != mids[-1]:
                    yield from compared([*waiting, b.slice(0, cut)])
                    waiting = []
                waiting.append(b.slice(cut))
        if waiting:
            yield from compared(waiting)

    return around.select("mid", "id", "v", "far").repartition("mid").sortWithinPartitions("mid", "id").mapInArrow(run, EDGES)


def nearest_edges(edges: DataFrame, pool: int) -> DataFrame:
    """The `pool` nearest distinct ends of each node, by one shuffle; a node has a few hundred candidates at most."""
    w = Window.partitionBy("src").orderBy("d", "dst")
    return edges.repartition("src").groupBy("src", "dst").agg(F.min("d").alias("d")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= pool).drop("_k")


#: Nodes whose neighbours are searched exactly to see how many a descent has found.
CHECKED = 500


def checked(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """src, true and last of nodes chosen by hash: how many nearest others they have, k at most, and the squared distance of the last of them."""
    some = nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(CHECKED)
    hits = S.knn(nodes, some, k, Metric.EUCLIDEAN, skip_self=True, id_col="id", vector_col="v")
    return F.broadcast(written(hits.groupBy(F.col("query_id").alias("src")).agg(F.count("*").alias("true"), F.max("distance").alias("last"))))  # CHECKED rows


def found_share(edges: DataFrame, check: DataFrame, k: int) -> float:
    """The share of the checked nodes' true k nearest others that are among their k nearest edges; as near ones count too."""
    w = Window.partitionBy("src").orderBy("d", "dst")
    own = edges.join(check, "src").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    true = check.agg(F.sum("true")).first()[0]
    return own.where(F.col("d") <= F.col("last") * (1 + 1e-9)).count() / true if true else 1.0


#: Bytes of a stretch's vectors, at most, as doubles.
STRETCH_BYTES = 16 << 20


def stretches(nodes: DataFrame, n: int, middle: np.ndarray, directions: np.ndarray, longest: int) -> DataFrame:
    """draw, stretch, id, v, far: the nodes once for each draw (draws x bits x dim), cut into stretches of at most `longest`.

    A draw halves the vectors by the side of the middle on which they lie along its first direction, the halves along the second and so on, and cuts what is so in
    order into stretches of about one length; what lies on the same sides is in order of a hash, which differs from draw to draw.
    """
    own = nodes.sparkSession.sparkContext.broadcast((middle, directions.reshape(-1, directions.shape[-1])))
    draws, bits = directions.shape[:2]
    kind = nodes.schema["v"].dataType.simpleString()

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, along = own.value
        for b in batches:
            up = ((S.matrix(b.column("v")) - center) @ along.T > 0).reshape(b.num_rows, draws, bits)
            code = (up * (1 << np.arange(bits - 1, -1, -1))).sum(2)
            for t in range(draws):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(code[:, t]), b.column("id"), b.column("v"), b.column("far")], ["draw", "code", "id", "v", "far"])

    cut = -(-n // longest)
    coded = nodes.mapInArrow(sides, f"draw int, code long, id long, v {kind}, far double").withColumn("_hash", F.xxhash64("draw", "id"))
    placed = ranks.numbered(coded, ["draw"], ["code", "_hash"])
    return placed.select("draw", F.floor((F.col("position") - 1) * cut / n).alias("stretch"), "id", "v", "far").repartition(max(1, min(2 * draws * cut, 2_000)), "draw", "stretch")


def descended(rows: DataFrame, k: int, pool: int | None = None, rounds: int = 12, starts: int = 6, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding", goal: float = 0.97) -> DataFrame:
    """src, rank, dst, distance: about the k nearest others of each vector, by descent over neighbours of neighbours; rows shuffled are linear in vectors.

    The start: vectors are halved along drawn directions, again and again, and each stretch of what is then in order compared among itself, `starts` times; a stretch has
    8 * pool^2 vectors, so that a node meets about as many others in one as in two rounds. A round gathers around every node its
    `pool` neighbours and about as many of those that have it as one (where there are more, as around a hub, a share of them drawn by hash), compares them with each
    other, and keeps for each the nearest; only pairs no farther than a node's farthest neighbour are sent on.
    Up to CHECKED nodes are searched exactly, and the descent ends when it has `goal` of their neighbours. Until then: while `starts` more draws find over half of what
    was missing, vectors are drawn anew; after that there are rounds, `rounds` at most, while each finds over a quarter of it; after that the pool is made twice as large and
    all begins again, as vectors without clusters need the more the more there are. Null vectors take no part; rows of one id must have one vector.
    """
    pool = pool or 3 * k
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "descent")
    nodes = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    nodes = written(nodes, f"{folder}/nodes")
    n, dim = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n or k <= 0:
        return spark.createDataFrame([], "src long, rank int, dst long, distance double")
    nodes = S.same_length(nodes, "v", dim)
    middle = np.array(nodes.agg(*[F.avg(F.get("v", F.lit(i)).cast("double")) for i in range(dim)]).first(), float) if dim else np.zeros(0)
    middle = np.where(np.isfinite(middle), middle, 0)
    draw, files, check = np.random.default_rng(seed), Files(spark), checked(nodes, k, seed)
    edges, made = spark.createDataFrame([], EDGES), 0

    def wanting() -> DataFrame:
        """The nodes with the squared distance up to which they want to know others."""
        far = edges.groupBy(F.col("src").alias("id")).agg(F.when(F.count(F.lit(1)) >= pool, F.max("d")).otherwise(F.lit(float("inf"))).alias("far"))
        return nodes.join(far, "id", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))

    def keep(found: DataFrame) -> float:
        """Puts what was found among the edges; the share of the checked nodes' neighbours that they have now."""
        nonlocal edges, made
        edges, made = written(nearest_edges(edges.unionByName(found), pool), f"{folder}/edges{made + 1}"), made + 1
        files.delete(f"{folder}/edges{made - 1}")
        return found_share(edges, check, k)

    def drawn() -> DataFrame:
        longest = max(2 * pool, min(8 * pool * pool, STRETCH_BYTES // (8 * max(dim, 1))))
        bits = min(40, 4 + (-(-n // longest) - 1).bit_length())
        return met(stretches(wanting() if made else nodes.withColumn("far", F.lit(float("inf"))), n, middle, draw.normal(size=(starts, bits, dim)), longest), ["draw", "stretch"], pool)

    def around() -> DataFrame:
        held = edges.groupBy(F.col("dst").alias("mid")).agg(F.count(F.lit(1)).alias("held"))
        share = F.pmod(F.xxhash64("src", "dst", F.lit(made), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) * F.col("held")
        behind = edges.join(held, edges["dst"] == held["mid"]).where(share < pool).select("mid", F.col("src").alias("id"))
        both = edges.select(F.col("src").alias("mid"), F.col("dst").alias("id")).unionByName(behind).unionByName(nodes.select(F.col("id").alias("mid"), "id"))
        return met_around(both.join(wanting(), "id"))

    share = 0.0
    while True:
        more = True
        while more and (share < goal or not made):
            before, share = share, keep(drawn())
            more = 1 - share < (1 - before) / 2
        more, left = True, rounds
        while more and left and share < goal:
            before, share, left = share, keep(around()), left - 1
            more = 1 - share < (1 - before) * 3 / 4
        if share >= goal or pool >= n:
            break
        pool *= 2
    w = Window.partitionBy("src").orderBy("d", "dst")
    top = edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("src", "rank", "dst", F.sqrt("d").alias("distance"))


def memberships(edges: DataFrame) -> DataFrame:
    """src, dst, w of edges (src, dst, distance): exp(-(distance - nearest) / sigma), with sigma such that a node's weights sum up to log2 of their number; then the
    union of both directions, a + b - a b, as an edge each way."""
    own = edges.groupBy("src").agg(F.collect_list(F.struct("dst", "distance")).alias("e"))  # a node's neighbours, k at most

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, sizes = b.column("e").flatten(), np.diff(b.column("e").offsets.to_numpy())
            node = np.repeat(np.arange(b.num_rows), sizes)
            dst, d = flat.field("dst").to_numpy(), flat.field("distance").to_numpy()
            least = np.full(b.num_rows, np.inf)
            np.minimum.at(least, node, d)
            d = d - least[node]
            goal, low, high = np.log2(np.maximum(sizes, 1)), np.zeros(b.num_rows), np.full(b.num_rows, np.inf)
            sigma = np.ones(b.num_rows)
            for _ in range(64):
                total = np.bincount(node, np.exp(-d / np.maximum(sigma, 1e-12)[node]), b.num_rows)
                high, low = np.where(total > goal, sigma, high), np.where(total > goal, low, sigma)
                sigma = np.where(np.isinf(high), sigma * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
            mean = np.bincount(node, d, b.num_rows) / np.maximum(sizes, 1)
            sigma = np.maximum(np.minimum(sigma, 1e6), np.maximum(1e-3 * mean, 1e-12))
            yield pa.RecordBatch.from_arrays([b.column("src").take(pa.array(node)), pa.array(dst), pa.array(np.exp(-d / sigma[node]))], ["src", "dst", "w"])

    w = own.mapInArrow(weigh, "src long, dst long, w double")
    both = w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.product("w")).otherwise(F.lit(0.0))).alias("w"))


def spectral(edges: DataFrame, nodes: DataFrame, dims: int, steps: int = 20, seed: int = 0, scale: float = 10.0) -> DataFrame:
    """num, p0, p1, ...: the first eigenvectors of the graph (s, t, w: each edge both ways) after the trivial one, by `steps` of power iteration, a join and a sum each.

    Between steps the vectors are made orthogonal to the trivial one and to each other by their inner products, (dims + 1)^2 sums over all nodes.
    """
    folder, files = shared_folder(edges.sparkSession, "spectral"), Files(edges.sparkSession)
    degree = edges.groupBy(F.col("s").alias("num")).agg(F.sum("w").alias("degree"))
    base = nodes.select("num").join(degree, "num", "left").select("num", F.sqrt(F.greatest(F.coalesce("degree", F.lit(0.0)), F.lit(1e-12))).alias("x0"))
    cols = [f"x{d}" for d in range(dims + 1)]
    x = written(base.select("num", "x0", *[(F.pmod(F.xxhash64("num", F.lit(d), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) - 0.5).alias(f"x{d}") for d in range(1, dims + 1)]), f"{folder}/x")
    for step in range(steps + 1):
        g = x.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in cols for b in cols]).first()
        gram = np.array([[g[f"{a}{b}"] for b in cols] for a in cols])
        turn = np.linalg.inv(np.linalg.cholesky(gram + 1e-12 * np.trace(gram) * np.eye(dims + 1))).T  # Gram and Schmidt's, x0 first
        ortho = [sum(F.col(cols[i]) * float(turn[i, j]) for i in range(j + 1)).alias(f"o{j}") for j in range(1, dims + 1)]
        if step == steps:
            most = x.select(*ortho).agg(*[F.max(F.abs(f"o{j}")).alias(f"m{j}") for j in range(1, dims + 1)]).first()
            return x.select("num", *ortho).select("num", *[(F.col(f"o{j}") / max(most[f"m{j}"], 1e-300) * scale).alias(f"p{j - 1}") for j in range(1, dims + 1)])
        o = x.select("num", "x0", *ortho)
        sent = edges.join(o.withColumnRenamed("num", "t"), "t").groupBy(F.col("s").alias("num")).agg(*[F.sum(F.col("w") * F.col(f"o{j}") / F.col("x0")).alias(f"y{j}") for j in range(1, dims + 1)])
        # half of each vector stays, so that all eigenvalues are positive and the largest ones are the wanted ones
        moved = o.join(sent, "num", "left").select("num", "x0", *[(F.col(f"o{j}") + F.coalesce(F.col(f"y{j}"), F.lit(0.0)) / F.col("x0")).alias(f"x{j}") for j in range(1, dims + 1)])
        after = written(moved, f"{folder}/x{step}")
        files.delete(f"{folder}/x{step - 1}" if step else f"{folder}/x")
        x = after


def curve(config: ProjectionConfig) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^(2b)) that fit the membership wanted by min_distance and spread, by Gauss-Newton steps."""
    x = np.linspace(1e-3, config.spread * 3, 300)
    y = np.where(x < config.min_distance, 1.0, np.exp(-(x - config.min_distance) / config.spread))
    p = np.array([1.0, 1.0])
    for _ in range(100):
        a, b = p
        g = x ** (2 * b)
        f = 1 / (1 + a * g)
        j = np.stack([-g * f * f, -a * g * 2 * np.log(x) * f * f], 1)
        p = np.maximum(p + np.linalg.solve(j.T @ j + 1e-6 * np.eye(2), j.T @ (y - f)), 1e-2)
    return float(p[0]), float(p[1])


def gradient(edges: DataFrame, layout: DataFrame, config: ProjectionConfig = ProjectionConfig(), limit: float = 4.0) -> DataFrame:
    """id, gradient of the attraction along the edges (src, dst, weight) for a layout (id, position): a join for each end and one sum."""
    a, b = curve(config)
    e = edges.join(layout.select(F.col("id").alias("src"), F.col("position").alias("p")), "src").join(layout.select(F.col("id").alias("dst"), F.col("position").alias("q")), "dst")
    diff = F.zip_with("p", "q", lambda x, y: x - y)
    d2 = F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)
    pull = F.when(d2 > 0, 2 * a * b * F.pow(d2, F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b)))).otherwise(F.lit(0.0)) * F.col("weight")
    e = e.select("src", "dst", F.transform(diff, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x * pull))).alias("g"))
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("g").alias("g")), F.struct(F.col("dst").alias("id"), F.transform("g", lambda x: -x).alias("g")))).alias("x")).select("x.*")
    sums = ends.select("id", F.posexplode("g").alias("d", "v")).groupBy("id", "d").agg(F.sum("v").alias("v"))
    return sums.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("c")).select("id", F.transform("c", lambda s: s["v"]).alias("gradient"))


def epoch_layout(edges: DataFrame, layout: DataFrame, epoch: int, n: int, config: ProjectionConfig, ab: tuple[float, float]) -> DataFrame:
    """The layout (num, p0, p1, ...) after one round over the edges (s, t, w) with w at most 1.

    An edge takes part with probability w and pulls its ends together. Each node is pushed from `negatives` others, found by shifting all
    numbers by a drawn step, once for each of its edges that take part. Pulls, pushes and positions are summed by node in one aggregation.
    """
    a, b = ab
    dims = range(config.dimensions)
    at = lambda x: [F.col(f"p{d}").alias(f"{x}{d}") for d in dims]
    diffs = [F.col(f"x{d}") - F.col(f"y{d}") for d in dims]
    d2 = sum((x * x for x in diffs[1:]), diffs[0] * diffs[0])
    within = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
    draw = F.pmod(F.xxhash64("s", "t", F.lit(epoch), F.lit(config.seed)), F.lit(1 << 30)) / float(1 << 30)
    pull = F.when(d2 > 0, -2 * a * b * F.pow(F.greatest(d2, F.lit(1e-12)), F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b)))).otherwise(F.lit(0.0))
    on = edges.where(draw < F.col("w")).join(layout.select(F.col("num").alias("s"), *at("x")), "s").join(layout.select(F.col("num").alias("t"), *at("y")), "t")
    on = on.select("s", "t", *[within(pull * x).alias(f"g{d}") for d, x in zip(dims, diffs, strict=True)])
    zero = lambda x: [F.lit(0.0).alias(f"{x}{d}") for d in dims]
    ends = F.explode(F.array(F.struct(F.col("s").alias("num"), F.lit(1.0).alias("sign")), F.struct(F.col("t").alias("num"), F.lit(-1.0).alias("sign")))).alias("end")
    pulls = on.select(ends, *[f"g{d}" for d in dims]).select("end.num", F.greatest("end.sign", F.lit(0.0)).alias("c"), *[(F.col("end.sign") * F.col(f"g{d}")).alias(f"g{d}") for d in dims], *zero("r"), *zero("p"))
    steps = np.random.default_rng([config.seed, epoch]).integers(1, n, config.negatives) if n > 1 else []
    push = 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, F.lit(b))))
    here = layout.select("num", F.lit(0.0).alias("c"), *zero("g"), *zero("r"), *[f"p{d}" for d in dims])
    moves = pulls.unionByName(here)
    if len(steps):
        away = layout.select("num", F.explode(F.array(*[F.pmod(F.col("num") + F.lit(int(k)), F.lit(n)) for k in steps])).alias("o"), *at("x"))
        away = away.join(layout.select(F.col("num").alias("o"), *at("y")), "o")
        moves = moves.unionByName(away.select("num", F.lit(0.0).alias("c"), *zero("g"), *[within(push * x).alias(f"r{d}") for d, x in zip(dims, diffs, strict=True)], *zero("p")))
    sums = moves.groupBy("num").agg(*[F.sum(f"{x}").alias(x) for x in ["c", *(f"{k}{d}" for k in "grp" for d in dims)]])
    rate = config.learning_rate * max(1 - epoch / config.iterations, 0.01)
    move = lambda d: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col(f"g{d}") + F.col("c") * F.col(f"r{d}")))
    return sums.select("num", *[(F.col(f"p{d}") + rate * move(d)).alias(f"p{d}") for d in dims])


def numbered(ids: DataFrame) -> DataFrame:
    """id, num: gapless numbers in order of id, from 0."""
    return ranks.numbered(ids, [], ["id"], "num").select("id", (F.col("num") - 1).alias("num"))


def project(rows: DataFrame, config: ProjectionConfig = ProjectionConfig(), id_col: str = "vec_id", vector_col: str = "embedding", approximate: bool = False, start: str = "spectral") -> DataFrame:
    """id, position: a layout of the neighbour graph by sampled attraction and repulsion, a Spark job for each round.

    approximate: takes the graph from descended() instead of comparing all pairs. start: spectral or random positions. Graph and layouts are Parquet tables in
    spark.checkpoint.dir (which a cluster must set), of which the newest layout alone is kept; nothing of them passes the driver, whatever the number of vectors.
    Vectors must have one length and finite elements; rows of one id count as one node.
    """
    spark: SparkSession = rows.sparkSession
    bad = F.exists(vector_col, lambda x: F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    n, low, high, wrong = rows.agg(F.count("*"), F.min(F.size(vector_col)), F.max(F.size(vector_col)), F.count_if(bad)).first()
    if not n or n <= config.neighbours or low != high or wrong:
        raise ProjectionError(f"{n} vectors of {low} to {high} elements, {wrong} of them not finite, for {config.neighbours} neighbours")
    folder, files = shared_folder(spark, "projection"), Files(spark)
    find = descended if approximate else knn_graph
    graph = written(memberships(find(rows, config.neighbours, id_col=id_col, vector_col=vector_col)), f"{folder}/graph")
    nodes = written(numbered(graph.select(F.col("src").alias("id")).distinct()), f"{folder}/nodes")
    n = nodes.count()
    number = lambda end, name: nodes.select(F.col("id").alias(end), F.col("num").alias(name))
    edges = written(graph.join(number("src", "s"), "src").join(number("dst", "t"), "dst").select("s", "t", "w"), f"{folder}/edges")
    noise = lambda d, width: (F.pmod(F.xxhash64("num", F.lit(d), F.lit(config.seed)), F.lit(1 << 30)) / float(1 << 30) - 0.5) * width
    if start == "spectral":
        first = spectral(edges, nodes, config.dimensions, seed=config.seed)
        first = first.select("num", *[(F.col(f"p{d}") + noise(d, 1e-3)).alias(f"p{d}") for d in range(config.dimensions)])
    else:
        first = nodes.select("num", *[noise(d, 20).alias(f"p{d}") for d in range(config.dimensions)])
    layout = written(first, f"{folder}/layout")
    ab, pulls = curve(config), edges.where("s < t")
    for epoch in range(config.iterations):
        layout = written(epoch_layout(pulls, layout, epoch, n, config, ab), f"{folder}/layout{epoch}")
        files.delete(f"{folder}/layout{epoch - 1}" if epoch else f"{folder}/layout")
    return nodes.join(layout, "num").select(F.col("id").cast("long").alias("id"), F.array(*[f"p{d}" for d in range(config.dimensions)]).alias("position"))


def trustworthiness(rows: DataFrame, layout: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """How much the k neighbours of each node in a layout (id, position) are those of its vector: 1 where all are. Compares all pairs: for measuring, on samples."""
    ours = S.knn(layout.withColumnsRenamed({"id": id_col, "position": vector_col}), layout.withColumnsRenamed({"id": id_col, "position": vector_col}), k, Metric.EUCLIDEAN, skip_self=True, id_col=id_col, vector_col=vector_col)
    n = layout.count()
    theirs = S.knn(rows, rows, n - 1, Metric.EUCLIDEAN, skip_self=True, id_col=id_col, vector_col=vector_col).select("query_id", "id", F.col("rank").alias("far"))
    over = ours.join(theirs, ["query_id", "id"]).agg(F.sum(F.greatest(F.col("far") - k, F.lit(0)))).first()[0] or 0
    return 1 - 2 * over / (n * k * (2 * n - 3 * k - 1))


def project_texts(docs: DataFrame, model: Embedder, config: ProjectionConfig = ProjectionConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, position of each text: embedded, then projected."""
    return project(embed(docs, model, id_col, text_col), config, id_col, "vector")
