"""Vector expressions on array columns. Sums are taken in double precision, in order, whatever the element type."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to this count as zero.
TINY = 1e-12


class Metric(str, Enum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    DOT = "dot"
    MANHATTAN = "manhattan"
    CHEBYSHEV = "chebyshev"


def col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def fold(values: Column, step) -> Column:
    return F.aggregate(values, F.lit(0.0), step)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products; 0 for empty vectors, an error for unequal lengths is left to `checked`."""
    return fold(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), lambda s, x: s + x)


def checked(a: Column | str, b: Column | str, value: Column, otherwise: Column | None = None) -> Column:
    """value where both vectors have one length, else `otherwise` (null)."""
    return F.when(F.size(col(a)) == F.size(col(b)), value).otherwise(F.lit(None) if otherwise is None else otherwise)


def sum_of_squares(v: Column | str) -> Column:
    return dot(v, v)


def norm(v: Column | str) -> Column:
    return F.sqrt(sum_of_squares(v))


def normalize(v: Column | str) -> Column:
    """Unit vector as doubles; a vector of (nearly) no length stays as it is."""
    return normalize_with(v, norm(v))


def normalize_with(v: Column | str, length: Column) -> Column:
    """The vector over a norm that is already known."""
    return let(length, lambda n: F.transform(col(v), lambda x: F.when(n > TINY, x.cast("double") / n).otherwise(x.cast("double"))))


def stable_total(values: Column) -> Column:
    """Sum by Neumaier's rule: what each addition rounds off is carried in a second sum, so large elements that cancel out leave the small ones whole."""
    zero = F.lit(0.0)

    def step(s: Column, x: Column) -> Column:
        add = lambda t: F.struct(t.alias("sum"), (s["carry"] + F.when(F.abs(s["sum"]) >= F.abs(x), (s["sum"] - t) + x).otherwise((x - t) + s["sum"])).alias("carry"))
        return let(s["sum"] + x, add)

    return F.aggregate(values, F.struct(zero.alias("sum"), zero.alias("carry")), step, lambda s: s["sum"] + s["carry"])


def stable_norm(v: Column | str) -> Column:
    """Norm of a vector of any magnitude: elements are scaled by the largest before they are squared, and their squares summed with a carry."""
    x = F.transform(col(v), lambda e: e.cast("double"))
    top = F.coalesce(F.array_max(F.transform(x, lambda e: F.abs(e))), F.lit(0.0))
    return let(F.struct(x.alias("x"), top.alias("m")), lambda s: F.when(s["m"] > 0, s["m"] * F.sqrt(stable_total(F.transform(s["x"], lambda e: (e / s["m"]) * (e / s["m"]))))).otherwise(F.lit(0.0)))


def normalize_stable(v: Column | str, zero: str = "keep") -> Column:
    """Unit vector by the stable norm, whatever the magnitude. A vector of zeros stays as it is (keep), becomes null (null) or the first unit vector (first)."""
    x = F.transform(col(v), lambda e: e.cast("double"))
    none = {"keep": lambda: x, "null": lambda: F.lit(None).cast("array<double>"), "first": lambda: F.transform(x, lambda e, i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))}[zero]()
    top = F.coalesce(F.array_max(F.transform(x, lambda e: F.abs(e))), F.lit(0.0))
    scaled = let(top, lambda m: F.when(m > 0, F.transform(x, lambda e: e / m)))  # first by the largest, as the norm itself may not fit a double
    return let(scaled, lambda y: F.when(y.isNotNull(), let(F.sqrt(stable_total(F.transform(y, lambda e: e * e))), lambda n: F.transform(y, lambda e: e / n))).otherwise(none))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if either norm is (nearly) 0."""
    return let(
        F.struct(norm(a).alias("x"), norm(b).alias("y"), dot(a, b).alias("d")),
        lambda s: F.when((s["x"] <= TINY) | (s["y"] <= TINY), F.lit(0.0)).otherwise(s["d"] / (s["x"] * s["y"])),
    )


def squared_euclidean(a: Column | str, b: Column | str) -> Column:
    return fold(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), lambda s, x: s + x)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column | str, b: Column | str) -> Column:
    return fold(F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y)), lambda s, x: s + x)


def chebyshev(a: Column | str, b: Column | str) -> Column:
    """Largest difference; 0 for empty vectors."""
    return F.coalesce(F.array_max(F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y))), F.lit(0.0))


def distance(a: Column | str, b: Column | str, metric: Metric) -> Column:
    """Pairwise distance: smaller is nearer (inner products are negated; euclidean is the root)."""
    return {
        Metric.COSINE: lambda: 1 - cosine(a, b),
        Metric.EUCLIDEAN: lambda: euclidean(a, b),
        Metric.DOT: lambda: -dot(a, b),
        Metric.MANHATTAN: lambda: manhattan(a, b),
        Metric.CHEBYSHEV: lambda: chebyshev(a, b),
    }[Metric(metric)]()


def similarity(d: Column, metric: Metric | None) -> Column:
    """Similarity of a search distance; for euclidean the distance is the square, for dot the negated product."""
    return {
        None: lambda: F.greatest(F.lit(0.0), 1 - d),
        Metric.COSINE: lambda: F.greatest(F.lit(0.0), 1 - d),
        Metric.EUCLIDEAN: lambda: F.exp(-F.sqrt(d)),
        Metric.DOT: lambda: (1 - d) / 2,
        Metric.MANHATTAN: lambda: F.exp(-d),
        Metric.CHEBYSHEV: lambda: F.exp(-d),
    }[None if metric is None else Metric(metric)]()


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") + y)


def multiply(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y)


def scale(v: Column | str, k: float) -> Column:
    return F.transform(col(v), lambda x: x.cast("double") * k)


def total(v: Column | str) -> Column:
    return fold(col(v), lambda s, x: s + x.cast("double"))


def mean(v: Column | str) -> Column:
    return F.when(F.size(col(v)) > 0, total(v) / F.size(col(v))).otherwise(F.lit(0.0))


def largest(v: Column | str) -> Column:
    return F.coalesce(F.array_max(col(v)).cast("double"), F.lit(-3.4028234663852886e38))


def smallest(v: Column | str) -> Column:
    return F.coalesce(F.array_min(col(v)).cast("double"), F.lit(3.4028234663852886e38))


def statistics(v: Column | str) -> Column:
    """Struct of count, min, max, mean, population stddev, l2 norm and range; zeros for an empty vector."""

    def of(m: Column) -> Column:
        n = F.size(col(v))
        var = fold(col(v), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m)) / n
        some = lambda x: F.when(n > 0, x).otherwise(F.lit(0.0))
        low, high = F.array_min(col(v)).cast("double"), F.array_max(col(v)).cast("double")
        return F.struct(n.alias("count"), some(low).alias("min"), some(high).alias("max"), some(m).alias("mean"), some(F.sqrt(F.greatest(F.lit(0.0), var))).alias("stddev"), some(norm(v)).alias("l2_norm"), some(high - low).alias("range"))

    return let(mean(v), of)


def is_normalized(v: Column | str, tolerance: float = 1e-4) -> Column:
    return (F.size(col(v)) > 0) & (F.abs(norm(v) - 1) <= tolerance)


def validity(v: Column | str) -> Column:
    """Struct of the numbers of NaN, +Inf and -Inf elements and whether there are none."""
    count = lambda test: F.size(F.filter(col(v), test))
    nan, inf = count(F.isnan), float("inf")
    up, down = count(lambda x: (x == inf) & ~F.isnan(x)), count(lambda x: x == -inf)
    return F.struct(nan.alias("nan"), up.alias("pos_inf"), down.alias("neg_inf"), (nan + up + down == 0).alias("valid"))


# Pooling of a matrix column (array of token vectors).


def selected(tokens: Column, mask: Column | None, empty: str) -> Column:
    """Tokens whose mask is not 0; where there are none, all of them (empty='all') or none (empty='zero')."""
    if mask is None:
        return tokens
    kept = F.transform(F.filter(F.zip_with(tokens, mask, lambda t, m: F.struct(t.alias("t"), m.alias("m"))), lambda s: s["m"] != 0), lambda s: s["t"])
    return kept if empty == "zero" else let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(tokens))


def zeros(tokens: Column) -> Column:
    return F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))


def pool_mean(tokens: Column | str, mask: Column | None = None, empty: str = "all") -> Column:
    t = col(tokens)
    return let(selected(t, mask, empty), lambda k: F.aggregate(k, zeros(t), lambda s, x: F.zip_with(s, x, lambda a, b: a + b.cast("double")), lambda s: F.transform(s, lambda x: F.when(F.size(k) > 0, x / F.size(k)).otherwise(x))))


def pool_max(tokens: Column | str, mask: Column | None = None, empty: str = "all") -> Column:
    t = col(tokens)

    def top(k: Column) -> Column:
        first = F.transform(F.get(k, F.lit(0)), lambda x: x.cast("double"))
        return F.when(F.size(k) > 0, F.aggregate(k, first, lambda s, x: F.zip_with(s, x, lambda a, b: F.greatest(a, b.cast("double"))))).otherwise(zeros(t))

    return let(selected(t, mask, empty), top)


def pool_cls(tokens: Column | str) -> Column:
    return F.transform(F.get(col(tokens), F.lit(0)), lambda x: x.cast("double"))


def pool_attention(tokens: Column | str, weights: Column) -> Column:
    """Weighted sum, over the weights' sum where that is neither (nearly) 0 nor 1."""
    t = col(tokens)
    summed = F.aggregate(F.zip_with(t, weights, lambda v, w: F.transform(v, lambda x: x.cast("double") * w)), zeros(t), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return let(F.struct(summed.alias("v"), total(weights).alias("w")), lambda s: F.transform(s["v"], lambda x: F.when((s["w"] > TINY) & (F.abs(s["w"] - 1) > 1e-6), x / s["w"]).otherwise(x)))


# Quantization.


def half_away(x: Column) -> Column:
    return F.round(x, 0)


def int8(v: Column | str) -> Column:
    """Struct of scale, min, max and codes: symmetric, scale = largest magnitude / 127 (1 if that is 0)."""
    top = F.array_max(F.transform(col(v), lambda x: F.abs(x.cast("double"))))
    return let(top, lambda m: let(F.when(m > 0, m / 127).otherwise(F.lit(1.0)), lambda s: F.struct(s.alias("scale"), (-m).alias("min"), m.alias("max"), F.transform(col(v), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), half_away(x.cast("double") / s).cast("int")))).alias("codes"))))


def int4(v: Column | str) -> Column:
    """Struct of scale and codes 1..15 (value + 8): symmetric, scale = largest magnitude / 7."""
    top = F.array_max(F.transform(col(v), lambda x: F.abs(x.cast("double"))))
    return let(top, lambda m: let(F.when(m > 0, m / 7).otherwise(F.lit(1.0)), lambda s: F.struct(s.alias("scale"), F.transform(col(v), lambda x: (F.greatest(F.lit(-7), F.least(F.lit(7), half_away(x.cast("double") / s).cast("int"))) + 8)).alias("codes"))))


def packed_nibbles(codes: Column) -> Column:
    """Two 4-bit codes in each number, the even-numbered one in the low half."""
    return F.transform(F.sequence(F.lit(0), F.size(codes) - 1, F.lit(2)), lambda i: F.get(codes, i) + 16 * F.coalesce(F.get(codes, i + 1), F.lit(0)))


def unpacked_nibbles(packed: Column, dim: Column) -> Column:
    return F.slice(F.flatten(F.transform(packed, lambda b: F.array(b % 16, F.floor(b / 16).cast("int")))), F.lit(1), dim)


def dequantized(codes: Column, scale_: Column, offset: Column | float = 0.0, zero: int = 0) -> Column:
    return F.transform(codes, lambda q: (q.cast("double") - zero) * scale_ + offset)


def binary(v: Column | str) -> Column:
    """32-bit words, lowest bit first: a bit is set where the element is positive."""
    n = F.size(col(v))
    return F.transform(F.sequence(F.lit(0), F.ceil(n / 32).cast("int") - 1), lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, k: s + F.when(F.coalesce(F.get(col(v), w * 32 + k).cast("double"), F.lit(0.0)) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0))))


def from_binary(words: Column, dim: Column) -> Column:
    """+1 for set bits, -1 for others."""
    return F.transform(F.sequence(F.lit(0), dim - 1), lambda k: F.when(F.call_function("shiftright", F.get(words, F.floor(k / 32).cast("int")), k % 32).bitwiseAND(1) == 1, F.lit(1.0)).otherwise(F.lit(-1.0)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def quantization_error(v: Column | str, back: Column) -> Column:
    """Struct of the largest and mean absolute error, rmse and cosine between a vector and its restored form."""
    n = F.size(col(v))
    return let(back, lambda w: F.struct(chebyshev(v, w).alias("max_abs"), (manhattan(v, w) / n).alias("mean_abs"), F.sqrt(squared_euclidean(v, w) / n).alias("rmse"), cosine(v, w).alias("cosine")))


# Flat buffers.


def unflattened(flat: Column | str, dim: int) -> Column:
    """Rows of `dim` elements of a row-major buffer; a rest that fills no row is left out."""
    n = F.floor(F.size(col(flat)) / dim).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), lambda i: F.slice(col(flat), i * dim + 1, F.lit(dim)))


def extracted(flat: Column | str, shape: str, *sizes: int) -> Column:
    """What a flat row-major buffer holds, by its shape: vector (all of it), scalar (its only element, else null), matrix (rows, columns), tensor (batches, rows,
    columns), similarities (a square matrix of so many rows) or concatenated (vectors of these lengths, one after the other). Null where the size does not fit."""
    v = col(flat)
    need = {"vector": lambda: None, "scalar": lambda: 1, "matrix": lambda: sizes[0] * sizes[1], "tensor": lambda: sizes[0] * sizes[1] * sizes[2], "similarities": lambda: sizes[0] ** 2, "concatenated": lambda: sum(sizes)}[shape]()
    starts = [1 + sum(sizes[:i]) for i in range(len(sizes))]
    out = {
        "vector": lambda: v,
        "scalar": lambda: F.get(v, F.lit(0)),
        "matrix": lambda: unflattened(v, sizes[1]),
        "tensor": lambda: F.transform(unflattened(v, sizes[1] * sizes[2]), lambda m: unflattened(m, sizes[2])),
        "similarities": lambda: unflattened(v, sizes[0]),
        "concatenated": lambda: F.array(*[F.slice(v, F.lit(at), F.lit(n)) for at, n in zip(starts, sizes, strict=True)]),
    }[shape]()
    return out if need is None else F.when(F.size(v) == need, out)


def all_normalized(v: Column | str, tolerance: float = 1e-4) -> Column:
    """Aggregate: whether there are vectors, all of one length (dimension) and norm 1."""
    return F.coalesce(F.bool_and(is_normalized(v, tolerance)) & (F.min(F.size(col(v))) == F.max(F.size(col(v)))), F.lit(False))


#: Bits of an element in each stored format, and bytes of the scale beside the elements.
FORMATS = {"float32": (32, 0), "float16": (16, 0), "int8": (8, 4), "int4": (4, 4), "binary": (1, 0)}


def bytes_per_element(form: str) -> float:
    return FORMATS[form][0] / 8


def compression_ratio(form: str) -> float:
    """How many times smaller a format's elements are than 32-bit floats, scales left aside."""
    return 32 / FORMATS[form][0]


def stored_bytes(elements: Column, form: str) -> Column:
    """Bytes of a vector of so many elements in a format, its scale included."""
    bits, scale = FORMATS[form]
    return (F.floor((elements * bits + 7) / 8) + scale).cast("long")
