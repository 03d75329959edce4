"""Chunks of documents with their places. Sentences and paragraphs are Column expressions in functions.text; the others walk a text and run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..models import Embedder, embed

CHUNK = "index int, total int, text string, start int, end int, overlap_previous int, overlap_next int"
Splitter = Callable[[str], list[str]]


@dataclass(frozen=True)
class Chunking:
    """kind: characters, tokens, sentences, paragraphs or custom; size: characters, tokens (4 characters each), sentences or paragraphs of a chunk."""

    kind: str = "characters"
    size: int = 400
    overlap: int = 50
    least: int = 10
    custom: Splitter | None = None


#: Presets.
SHORT, LONG, SENTENCES = Chunking("characters", 400, 20, 100), Chunking("characters", 200, 50, 50), Chunking("sentences", 5, 30, 20)


def by_characters(text: str, size: int, overlap: int, least: int) -> list[str]:
    """Windows of `size` characters that end behind the last white space among their last min(50, size / 4), if there is any; a window shorter than
    `least` joins the one before. Lengths count code points."""
    out: list[str] = []
    overlap, at = min(overlap, size // 2), 0
    while size > 0 and at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            low = max(at, end - min(50, size // 4))
            end = next((i + 1 for i in range(end - 1, low - 1, -1) if text[i].isspace()), end)
        piece = text[at:end]
        if len(piece) >= least or not out:
            out.append(piece)
        else:
            out[-1] += piece
        if end >= len(text):
            break
        at += max(1, end - at - overlap)
    return out


def located(parts: list[str], text: str, overlap: int) -> list[dict]:
    """Chunks with their offsets: each is looked for from the end of the one before, less the overlap; one that is not found follows it."""
    out: list[dict] = []
    at = 0
    for i, p in enumerate(parts):
        start = text.find(p, max(0, at - overlap))
        if start >= 0:
            end = start + len(p)
            before, after = (max(0, out[-1]["end"] - start) if i else 0), (overlap if i < len(parts) - 1 else 0)
        else:
            start, end, before, after = at, at + len(p), 0, 0
        out.append({"index": i, "total": len(parts), "text": p, "start": start, "end": end, "overlap_previous": before, "overlap_next": after})
        at = end
    return out


def chunk(docs: DataFrame, how: Chunking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the chunks of each document, a row each; documents without text have none."""
    ready = {"sentences": lambda: T.chunk_sentences(text_col, how.size, how.overlap, how.least), "paragraphs": lambda: T.chunk_paragraphs(text_col, how.size, how.overlap, how.least)}
    parts = ready[how.kind]() if how.kind in ready else F.lit(None).cast("array<string>")
    split: dict[str, Splitter] = {"characters": lambda t: by_characters(t, how.size, how.overlap, how.least), "tokens": lambda t: by_characters(t, how.size * 4, how.overlap, how.least)}
    if how.custom is not None:
        split["custom"] = how.custom
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in CHUNK.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i in range(b.num_rows):
                t = b.column(1)[i].as_py() or ""
                own = b.column(2)[i].as_py() if how.kind in ready else split[how.kind](t)
                got = located(own or [], t, how.overlap)
                at += [i] * len(got)
                rows += got
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *[pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]], names=[id_col, *names])

    return docs.select(id_col, F.col(text_col).alias("text"), parts.alias("parts")).mapInArrow(run, f"`{id_col}` {kind}, {CHUNK}")


def chunk_tokens(tokenized: DataFrame, size: int, overlap: int = 0, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Chunks of `size` tokens that share min(overlap, size / 2): id_col, index, total, text (the tokens joined), n_tokens, start, end (characters before, estimated)."""
    shared = min(overlap, size // 2)
    stride = max(1, size - shared)
    t = F.col(tokens_col)
    n = F.size(t)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / stride).cast("int") + 1)
    before = lambda k: F.aggregate(F.slice(t, F.lit(1), k), F.lit(0), lambda s, x: s + F.length(x))
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("index"), count.alias("total"), F.array_join(F.slice(t, i * stride + 1, F.lit(size)), "").alias("text"), F.size(F.slice(t, i * stride + 1, F.lit(size))).alias("n_tokens"), before(i * stride).alias("start"), before(F.least(i * stride + size, n)).alias("end")))
    return tokenized.where(n > 0).select(id_col, F.inline(parts))


def aggregate(chunks: DataFrame, how: str = "mean", id_col: str = "doc_id", vector_col: str = "vector", index_col: str = "index", weight_col: str | None = None, normalize: bool = True, skip_mismatched: bool = False) -> DataFrame:
    """One vector for each document: mean, weighted (by weight_col), first, last or concatenate of its chunks' vectors, of length 1 unless told otherwise.

    Means are taken element by element: partial sums are combined before the shuffle. With skip_mismatched, vectors of another length than the first chunk's are left
    out of the sum but not of the count.
    """
    v = F.transform(vector_col, lambda x: x.cast("double"))
    if how in ("first", "last"):
        pick = F.min_by if how == "first" else F.max_by
        out = chunks.groupBy(id_col).agg(pick(v, F.col(index_col)).alias("vector"))
    elif how == "concatenate":
        out = chunks.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col(index_col).alias("i"), v.alias("v")))).alias("c")).select(id_col, F.flatten(F.transform("c", lambda s: s["v"])).alias("vector"))
    elif how in ("mean", "weighted"):
        w = F.lit(1.0) if how == "mean" else F.col(weight_col).cast("double")
        rows = chunks.select(id_col, F.col(index_col).alias("_i"), v.alias("_v"), w.alias("_w"))
        if skip_mismatched:
            dim = rows.groupBy(id_col).agg(F.min_by(F.size("_v"), F.col("_i")).alias("_dim"))
            rows = rows.join(dim, id_col).withColumn("_v", F.when(F.size("_v") == F.col("_dim"), F.col("_v")).otherwise(F.array().cast("array<double>"))).drop("_dim")
        # the first element stands for the weights, so that the rows, which may come from a model, are made once
        elements = F.concat(F.array(F.lit(1.0)), F.coalesce("_v", F.array().cast("array<double>")))
        sums = rows.select(id_col, "_w", F.posexplode(elements).alias("_d", "_x")).groupBy(id_col, "_d").agg(F.sum(F.col("_x") * F.col("_w")).alias("_s"))
        vec = sums.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_d", "_s"))).alias("_c")).where(F.size("_c") > 1)
        total, rest = F.get("_c", F.lit(0))["_s"], F.slice("_c", F.lit(2), F.size("_c") - 1)
        out = vec.select(id_col, total.alias("_total"), rest.alias("_c")).select(id_col, F.transform("_c", lambda s: F.when(F.col("_total") > 0, s["_s"] / F.col("_total")).otherwise(s["_s"])).alias("vector"))
    else:
        raise ValueError(f"unknown aggregation {how}")
    return out.select(id_col, V.normalize("vector").alias("vector")) if normalize else out


def aggregate_custom(chunks: DataFrame, function: Callable[[list[list[float]]], list[float]], id_col: str = "doc_id", vector_col: str = "vector", index_col: str = "index") -> DataFrame:
    """A document's vector by a function of its chunks' vectors in order; a document's chunks are one group."""
    kind = chunks.schema[id_col].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        g = group.sort_by(index_col)
        return pa.table({id_col: g.column(id_col).slice(0, 1), "vector": pa.array([function(g.column(vector_col).to_pylist())], pa.list_(pa.float64()))})

    return chunks.select(id_col, index_col, vector_col).groupBy(id_col).applyInArrow(run, f"`{id_col}` {kind}, vector array<double>")


def embed_documents(docs: DataFrame, how: Chunking, model: Embedder, aggregated: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks of each document with their vectors; with `aggregated` (mean, weighted by characters, first, last, concatenate) one vector for each document.

    Chunks and vectors travel in one row: the chunk is the key under which its text is embedded.
    """
    c = chunk(docs, how, id_col, text_col)
    v = embed(c.select(F.struct(*c.columns).alias("_key"), "text"), model, "_key", "text")
    both = v.select(*[f"_key.{x}" for x in c.columns], "vector")
    return both if aggregated is None else aggregate(both.withColumn("_w", F.length("text")), aggregated, id_col, weight_col="_w")
