"""Language identification by multilingual mixture inference.

A model holds, for every language, smoothed likelihoods of hashed letter trigrams. A document's trigrams are taken as drawn from a mixture of
languages; expectation-maximisation estimates the proportions. The language set grows greedily from the likeliest single language, a language joining
only if the log-likelihood gains more than a penalty of half the logarithm of the trigram count (BIC). The prediction is the set's largest part.

Defined results: null texts and texts without a letter are `und` with score 0; without any labelled row every text is `und`; repeated rows each get
their row; rows with a null language teach nothing; whole texts are read, however long.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of a text (words set apart by one space) and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0)
    c = np.where(is_letter, c, 32)
    gap = c == 32
    c = np.concatenate([[32], c[~(gap & np.concatenate([[True], gap[:-1]]))], [32]]).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    h = ((h * np.uint64(0x27D4EB2F)) >> np.uint64(15) & np.uint64(BUCKETS - 1)).astype(np.int64)
    if len(h) < 4000:
        return np.unique(h, return_counts=True)
    n = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def proportions(like: np.ndarray, counts: np.ndarray, start: np.ndarray | None = None, rounds: int = 200, close: float = 1e-4) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation-maximisation over likelihoods (languages by trigrams), until none moves by more than `close`, and the log-likelihood."""
    share = np.full(len(like), 1 / len(like)) if start is None else start
    total = counts.sum()
    for _ in range(rounds):
        after = share * (like @ (counts / (share @ like))) / total
        moved = np.abs(after - share).max()
        share = after
        if moved <= close:
            break
    return share, float(counts @ np.log(share @ like))


def infer(likelihood: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[dict[int, float], float]:
    """Proportions of the selected languages, and the certainty of the first against all others on its own.

    The set grows from the likeliest single language. Each step tries every language that is not in it yet: first by what a small share of it would gain, which
    bounds the rest (the log-likelihood is concave in the shares), then the most promising ones in full, until no other can gain more than the best found.
    """
    like = likelihood[:, at]
    alone = np.log(like) @ counts
    first = int(np.argmax(alone))
    chosen, share, best = [first], np.ones(1), float(alone[first])
    certainty = 1 / np.exp(np.maximum(alone - best, -700)).sum()
    penalty = 0.5 * np.log(counts.sum() + 1)
    while len(chosen) < len(likelihood):
        mixed = share @ like[chosen]
        slope = like @ (counts / mixed) - counts.sum()  # of the log-likelihood towards each language: no mixture with it gains more than this
        found = None
        for k in np.argsort(-slope, kind="stable").tolist():
            if slope[k] <= max(penalty, found[1] - best if found else 0.0):
                break
            if k not in chosen:
                own = (*proportions(like[[*chosen, k]], counts, np.append(share * 0.9, 0.1)), k)
                found = own if found is None or own[1] > found[1] else found
        if found is None or found[1] <= best + penalty:
            break
        share, best = found[0], found[1]
        chosen.append(found[2])
    return dict(zip(chosen, share.tolist(), strict=True)), float(certainty)


def fit(labelled: DataFrame, per_language: int = 1500, smoothing: float = 0.2, text_col: str = "text", lang_col: str = "lang", key: Column | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram likelihoods, learned from about per_language rows of each, chosen by hash."""
    key = F.xxhash64(F.col(text_col)) if key is None else F.xxhash64(key)
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row per language
    if not sizes:
        return [], np.empty((0, BUCKETS))
    odds = F.lit(0.0)
    for lang, n in sizes.items():
        odds = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_language / n))).otherwise(odds)
    sample = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(key, F.lit(1 << 20)).alias("h")).where(F.col("h") < odds * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}  # a fixed table for each language, whatever the texts
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at, n = trigrams(t.as_py())
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "at", "n"])

    totals = {x: np.zeros(BUCKETS) for x in sizes}
    met = sample.select("lang", "text").mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    for lang, at, n in met.collect():  # at most BUCKETS rows a language
        totals[lang][at] = n
    langs = sorted(totals)
    table = np.array([totals[x] for x in langs]) + smoothing
    return langs, table / table.sum(1, keepdims=True)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and languages (map of the selected languages to their proportions)."""
    langs, likelihood = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, likelihood.astype(np.float32)))  # languages times a fixed table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for b in batches:
            langs_, scores, parts = [], [], []
            for t in b.column(1):
                at, counts = trigrams(t.as_py() or "")
                if not len(at) or not names:
                    langs_.append("und"), scores.append(0.0), parts.append([])
                    continue
                share, sure = infer(table, at, counts)
                best = max(share, key=lambda k: share[k])
                langs_.append(names[best]), scores.append(min(1.0, max(0.0, share[best] * sure))), parts.append([(names[k], v) for k, v in share.items()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs_, pa.string()), pa.array(scores, pa.float64()), pa.array(parts, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string, double>")
