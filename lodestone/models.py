"""Embedding models as functions of texts, run over DataFrames in Arrow batches; a deterministic model for tests; a registry."""

from __future__ import annotations

import math
import re
import zlib
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .errors import InferenceFailed, InputTooLong, InvalidInput, ModelLoadFailed, ModelNotFound
from .functions import vectors as V
from .plans.config import BatchConfig, EmbeddingConfig


class Embedder(ABC):
    """A model: texts in, vectors of `dimension` elements out. Instances must pickle; they are loaded once in a worker."""

    name = "model"
    dimension = 0

    @abstractmethod
    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


def crc_table() -> np.ndarray:
    """The checksum's change by a byte: zlib's polynomial."""
    t = np.arange(256, dtype=np.int64)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ 0xEDB88320, t >> 1)
    return t


CRC = crc_table()
#: Bytes of words whose grams are held at once, about.
PIECE = 1 << 18


class HashEmbedder(Embedder):
    """Vectors without a model file, by signed feature hashing: the character n-grams of a text's words, with marks where words begin and end, are counted; one
    checksum of a gram names the element it adds to, another its sign. Texts that share words or parts of words have similar vectors; a text without a letter or digit has
    the vector of the mark alone."""

    name = "hash"

    def __init__(self, dimension: int = 384, normalize: bool = True, sizes: Sequence[int] = (3, 4, 5)):
        self.dimension, self.normalize, self.sizes = dimension, normalize, tuple(sizes)

    def packed(self, words: list[bytes]) -> np.ndarray:
        """The grams of marked words, in order of word, size and place: up to seven bytes, the first one lowest, and their number in the highest byte."""
        lengths, sizes = np.array([len(w) for w in words]), np.array(self.sizes)
        deep = max(self.sizes)
        text = np.frombuffer(b"".join(words) + bytes(deep - 1), np.uint8).astype(np.int64)
        ahead = sum(text[k : len(text) - deep + 1 + k] << 8 * k for k in range(deep))
        many = np.maximum(1, lengths[:, None] - sizes + 1).ravel()
        start = np.repeat(np.cumsum(lengths) - lengths, len(sizes)) - (np.cumsum(many) - many)
        width = np.repeat(np.minimum(lengths[:, None], sizes).ravel(), many)
        return ahead[np.repeat(start, many) + np.arange(len(width))] & (1 << 8 * width) - 1 | width << 56

    def placed(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The element of each packed gram, by its CRC-32, and its sign, by the lowest bit of its Adler-32, which is the parity of one and its bytes."""
        width, crc = grams >> 56, np.full(len(grams), 0xFFFFFFFF)
        sums = np.ones(len(grams), np.int64)
        for k in range(max(self.sizes)):
            byte = grams >> 8 * k & 255
            sums += np.where(k < width, byte, 0)
            crc = np.where(k < width, CRC[(crc ^ byte) & 255] ^ crc >> 8, crc)
        return (crc ^ 0xFFFFFFFF) % self.dimension, np.where(sums & 1, 1, -1)

    def counted(self, marked: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Element, sign and count of the distinct grams, in the order in which they come."""
        if max(self.sizes) > 7 or min(self.sizes) < 1:
            grams = Counter(w[i : i + n] for w in marked for n in self.sizes for i in range(max(1, len(w) - n + 1)))
            return np.array([zlib.crc32(g) % self.dimension for g in grams]), np.array([1 if zlib.adler32(g) & 1 else -1 for g in grams]), np.array(list(grams.values()))
        piece = np.cumsum([len(w) for w in marked]) // PIECE
        cuts = [*(np.flatnonzero(np.diff(piece)) + 1), len(marked)]
        grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for low, high in zip([0, *cuts], cuts):
            which, both = pd.factorize(np.concatenate([grams, self.packed(marked[low:high])]))
            counts, grams = np.bincount(which[len(grams) :], minlength=len(both)) + np.pad(counts, (0, len(both) - len(grams))), both
        return *self.placed(grams), counts

    def vector(self, text: str) -> np.ndarray:
        element, sign, counts = self.counted([f"<{w}>".encode() for w in re.findall(r"[^\W_]+", text.casefold())] or [b"<>"])
        sizes, which = np.unique(counts, return_inverse=True)
        v = np.bincount(element, sign * np.array([1 + math.log(n) for n in sizes])[which], self.dimension)
        length = float(np.linalg.norm(v))
        if not length:  # all signs cancelled out
            v[0] = length = 1.0
        return v / length if self.normalize else v

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return np.array([self.vector(t) for t in texts]).reshape(len(texts), self.dimension)


def embed(rows: DataFrame, model: Embedder, id_col: str = "doc_id", text_col: str = "text", batch: int = 32, strict: bool = False) -> DataFrame:
    """id_col and vector (array of float) of each row. Null text counts as empty; with strict, text without other than white space raises."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                texts = [t.as_py() or "" for t in b.column(1).slice(at, batch)]
                if strict and any(not t.strip() for t in texts):
                    raise InvalidInput("a text is empty")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, batch), pa.array(list(model.embed(texts).astype(np.float32)), pa.list_(pa.float32()))], names=[id_col, "vector"])

    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, vector array<float>")


def embed_once(rows: DataFrame, model: Embedder, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The same, with each distinct text embedded once: for relations with many repeated texts."""
    text = F.coalesce(text_col, F.lit(""))
    keyed = rows.select(id_col, text.alias("_t"), F.sha2(text, 256).alias("_k"))  # joined by digests, so that texts are shuffled once
    vectors = embed(keyed.select("_k", "_t").distinct(), model, "_k", "_t", **how)
    return keyed.select(id_col, "_k").join(vectors, "_k").select(id_col, "vector")


def pooled(rows: DataFrame, tokens_col: str, pooling: str = "mean", mask_col: str | None = None, weights_col: str | None = None, normalize: bool = True, empty: str = "all") -> DataFrame:
    """The rows with vector: the pooled, normalized token matrix."""
    mask = F.col(mask_col) if mask_col else None
    v = {"mean": lambda: V.pool_mean(tokens_col, mask, empty), "max": lambda: V.pool_max(tokens_col, mask, empty), "cls": lambda: V.pool_cls(tokens_col), "attention": lambda: V.pool_attention(tokens_col, F.col(weights_col)) if weights_col else V.pool_mean(tokens_col, mask, empty)}[pooling]()
    return rows.withColumn("vector", V.normalize(v) if normalize else v)


class TokenModel(ABC):
    """A model of token matrices: padded token ids and their mask in, a vector for each token out. Instances must pickle; they are loaded once in a worker."""

    name = "tokens"
    dimension = 0

    @abstractmethod
    def run(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(rows, length) integers and booleans -> (rows, length, dimension) numbers; what stands where the mask is False is not used."""

    def weights(self, ids: np.ndarray, mask: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Attention weights (rows, length), for attention pooling; equal ones unless a model knows better."""
        return mask.astype(float)


class ModularModel(TokenModel):
    """A model without a file: element j of a token's vector is ((id * (j + 1) + position) mod `modulus`) / modulus. For tests and benches."""

    name = "modular"

    def __init__(self, dimension: int = 8, modulus: int = 1000):
        self.dimension, self.modulus = dimension, modulus

    def run(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return (ids[:, :, None] * np.arange(1, self.dimension + 1) + np.arange(ids.shape[1])[None, :, None]) % self.modulus / self.modulus


def pooled_matrix(out: np.ndarray, mask: np.ndarray, pooling: str, weights: np.ndarray | None = None) -> np.ndarray:
    """(rows, dimension): each row's tokens pooled, those of its padding left out; a row without tokens gives zeros."""
    out, held = out.astype(float), mask.sum(1)
    if pooling == "cls":
        return np.where((held > 0)[:, None], out[:, 0], 0.0) if out.shape[1] else np.zeros((len(out), out.shape[2]))
    if pooling == "max":
        top = np.where(mask[:, :, None], out, -np.inf).max(1, initial=-np.inf)
        return np.where((held > 0)[:, None], top, 0.0)
    share = np.where(mask, 1.0 if pooling == "mean" else weights, 0.0)
    total = share.sum(1)
    return np.einsum("rl,rld->rd", share, np.where(mask[:, :, None], out, 0.0)) / np.where(np.abs(total) > V.TINY, total, 1.0)[:, None]


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(1))[:, None]
    return np.where(n > V.TINY, v / np.where(n > V.TINY, n, 1.0), v)


def cut_ids(ids: np.ndarray, most: int, how: str) -> np.ndarray:
    """At most `most` ids: the first (end), the last (start), or half from each side (middle); none raises on more."""
    if len(ids) <= most:
        return ids
    if how == "none":
        raise InputTooLong(f"{len(ids)} tokens, at most {most} are allowed")
    head = {"end": most, "start": 0, "middle": most // 2}[how]
    return np.concatenate([ids[:head], ids[len(ids) - (most - head) :]])


class MicroBatches:
    """Rows gathered by padded length; a bucket that is full comes out as a batch. What waits holds `hold` tokens at most, else the fullest bucket comes out."""

    def __init__(self, config: BatchConfig, hold: int = 1 << 20):
        self.config, self.hold, self.held = config, hold, 0
        self.waiting: dict[int, list] = {}

    def length(self, n: int) -> int:
        return -(-max(n, 1) // self.config.bucket) * self.config.bucket

    def capacity(self, length: int) -> int:
        fits = self.config.max_batch if self.config.max_tokens is None else min(self.config.max_batch, max(1, self.config.max_tokens // length))
        return max(self.config.min_batch, fits)

    def add(self, n: int, row: object) -> Iterator[tuple[int, list]]:
        length = self.length(n)
        rows = self.waiting.setdefault(length, [])
        rows.append(row)
        self.held += length
        if len(rows) >= self.capacity(length):
            yield self.out(length)
        while self.held > self.hold:
            yield self.out(max(self.waiting, key=lambda k: k * len(self.waiting[k])))

    def out(self, length: int) -> tuple[int, list]:
        rows = self.waiting.pop(length)
        self.held -= length * len(rows)
        return length, rows

    def rest(self) -> Iterator[tuple[int, list]]:
        for length in sorted(self.waiting):
            yield self.out(length)


RUN = "vector array<double>, tokens int, padded int, batch_rows int, truncated boolean"


def run_model(rows: DataFrame, model: TokenModel, ids_col: str = "ids", id_col: str = "doc_id", config: EmbeddingConfig = EmbeddingConfig(), batches: BatchConfig = BatchConfig()) -> DataFrame:
    """id_col, vector, tokens (after truncation), padded (the length its batch was padded to), batch_rows and truncated of each row's token ids.

    Rows of about the same length form micro-batches inside each partition, without a shuffle; a batch is padded to its bucket's length and run at once, and the
    padding takes no part in the pooling. Null ids count as none; a row without ids has a vector of zeros.
    """
    kind = rows.schema[id_col].dataType

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = MicroBatches(batches)
        pending: list[pa.RecordBatch] = []
        for b in source:
            for key, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                given = ids.values.to_numpy(zero_copy_only=False).astype(np.int64) if ids.is_valid else np.empty(0, np.int64)
                own = cut_ids(given, config.max_tokens, config.truncation)
                pending += (infer(*x) for x in gather.add(len(own), (key, own, len(own) < len(given))))
            yield from pending
            pending.clear()
        for x in gather.rest():
            yield infer(*x)

    def infer(length: int, some: list) -> pa.RecordBatch:
        ids, mask = np.zeros((len(some), length), np.int64), np.zeros((len(some), length), bool)
        for i, (_, own, _) in enumerate(some):
            ids[i, : len(own)], mask[i, : len(own)] = own, True
        out = model.run(ids, mask)
        if out.shape != (*ids.shape, model.dimension):
            raise InferenceFailed(f"{model.name} gave an output of shape {out.shape} for {ids.shape} ids")
        v = pooled_matrix(out, mask, config.pooling, model.weights(ids, mask, out) if config.pooling == "attention" else None)
        v = unit(v) if config.normalize else v
        arrays = [pa.array([r[0] for r in some], key_kind), pa.array(list(v), pa.list_(pa.float64())), pa.array(mask.sum(1), pa.int32()), pa.array([length] * len(some), pa.int32()), pa.array([len(some)] * len(some), pa.int32()), pa.array([r[2] for r in some])]
        return pa.RecordBatch.from_arrays(arrays, [id_col, *(x.split()[0] for x in RUN.split(", "))])

    key_kind = to_arrow_type(kind)
    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {RUN}")


def padding_shares(run: DataFrame) -> DataFrame:
    """padded, rows, tokens, padding and share: how much of what a model ran over was padding, by padded length."""
    padding = F.sum(F.col("padded") - F.col("tokens"))
    return run.groupBy("padded").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), padding.alias("padding"), (padding / F.sum("padded")).alias("share"))


class Registry:
    """Models by name, loaded when first asked for, with counts of what they embedded."""

    def __init__(self) -> None:
        self.makers = {"hash": HashEmbedder}
        self.loaded: dict[str, Embedder] = {}
        self.watched: dict[str, list[Observation]] = {}

    def register(self, name: str, maker) -> None:
        self.makers[name] = maker

    def load(self, name: str, **how) -> Embedder:
        if name not in self.makers:
            raise ModelNotFound(name)
        if name not in self.loaded:
            try:
                self.loaded[name] = self.makers[name](**how)
            except Exception as e:
                raise ModelLoadFailed(f"{name}: {e}") from e
        return self.loaded[name]

    def unload(self, name: str) -> None:
        self.loaded.pop(name, None)

    def unload_all(self) -> None:
        self.loaded.clear()

    def embed(self, name: str, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
        """embed() by a model of the registry. The rows that its jobs embed are counted as they run, see metrics()."""
        out = embed(rows, self.load(name), id_col, text_col, **how)
        watch = Observation()
        self.watched.setdefault(name, []).append(watch)
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        return out.observe(watch, F.count("*").alias("rows"), F.coalesce(F.sum(length), F.lit(0.0)).alias("lengths"), F.count_if(length <= V.TINY).alias("zeros"))

    def metrics(self, name: str) -> dict:
        """Runs, rows, mean length of the vectors and vectors without length of a model's runs that have ended."""
        done = [w.get for w in self.watched.get(name, []) if getattr(w, "_jo", None) is not None and w._jo.future().isCompleted()]
        rows = sum(d["rows"] for d in done)
        return {"runs": len(done), "rows": rows, "mean_length": sum(d["lengths"] for d in done) / rows if rows else 0.0, "zeros": sum(d["zeros"] for d in done)}


def output_shape(shape: Sequence[int], tokens: int) -> tuple[int, int]:
    """Rows and columns of a model's output: a vector is one row; leading ones of three dimensions are dropped; a flat output is split by the token count if that fits."""
    s = list(shape)
    while len(s) > 2 and s[0] == 1:
        s = s[1:]
    if len(s) == 2:
        return s[0], s[1]
    if len(s) == 1:
        return (tokens, s[0] // tokens) if tokens and s[0] % tokens == 0 and s[0] > tokens else (1, s[0])
    raise InvalidInput(f"output of shape {list(shape)}")


def quick_embed(spark: SparkSession, texts: Sequence[str], name: str = "hash", **how) -> DataFrame:
    """text and vector of a few texts, by a model of the registry."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos long, text string")
    return rows.join(embed(rows, Registry().load(name, **how), "pos"), "pos").orderBy("pos").select("text", "vector")
