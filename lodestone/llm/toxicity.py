"""Toxicity by weak supervision.

Voters are lexicon entries (words and word beginnings, seen once or twice) and surface patterns; labels choose which entries may vote. A generative label model
estimates from the votes how often each fires on toxic and on clean texts, by expectation-maximisation that the labels start and join as one more, noisy voter,
whose rates are estimated like the others'; votes that correlate within a class are weighed down by their correlations. A logistic classifier is trained on
the posterior labels and scores every whole text. Without the labels' vote the estimate settles on the voters of one language (see the README).

All that is counted in texts is counted by Spark; the driver takes bounded tables: at most 20 * voters entries, and a row of features for each of `rows` texts.

Defined results: null and empty texts get the score of a text without features; without labelled rows of both kinds every score is 0; labels with null ids or
null toxic teach nothing, and of rows of one id the least text teaches, with the greatest label; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
SHOUT, BANG, DRAWN = re.compile(r"\b[A-Z]{4,}\b"), re.compile(r"!{2,}"), re.compile(r"([^\W\d_])\1{3,}")


def counts(text: str) -> Counter:
    """Occurrences of words and of word beginnings (marked with *)."""
    c: Counter = Counter()
    for w, n in Counter(WORDS.findall(text.lower())).items():
        c[w] += n
        for k in PREFIXES:
            if len(w) >= k:
                c[w[:k] + "*"] += n
    return c


def patterns(text: str) -> list[int]:
    return [len(SHOUT.findall(text)), len(BANG.findall(text)), len(DRAWN.findall(text))]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25, trust: float = 0.9) -> tuple[np.ndarray, dict]:
    """Posterior probability of toxic for each row of 0/1 votes, and the model: rates of each voter by class and weights by correlation."""
    v, n = np.column_stack([votes, labels]).astype(float), len(votes)
    q = np.where(labels > 0, trust, 1 - trust)
    weight = np.ones(v.shape[1])
    for r in range(rounds):
        a = (q @ v + 0.5) / (q.sum() + 1)
        b = ((1 - q) @ v + 0.5) / (n - q.sum() + 1)
        if r % 5 == 0:  # correlations within the classes, which independent votes would not have
            weight = np.zeros(v.shape[1])
            for p, rate in ((q, a), (1 - q, b)):
                z = (v - rate) * np.sqrt(p)[:, None]
                cov = z.T @ z
                d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr = np.clip(cov / d / d[:, None], 0, 1)
                np.fill_diagonal(corr, 0)
                weight += 0.5 / (1 + np.where(corr > 0.1, corr, 0).sum(1))
            weight[-1] = 1  # the labels' voter
        llr = v * np.log(a / b) + (1 - v) * np.log((1 - a) / (1 - b))
        prior = np.log(q.mean() / (1 - q.mean()))
        q = 1 / (1 + np.exp(-np.clip(llr @ weight + prior, -30, 30)))
        q = np.clip(q, 1e-4, 1 - 1e-4)
    return q, {"toxic": a, "clean": b, "weight": weight}


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights (the last one constant) of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, x.T @ (p - q) + pen * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def features(text: str, names: dict[str, int]) -> np.ndarray:
    """For each lexicon entry: seen, seen twice, three times, and share of the words; then the patterns' logarithms."""
    words = Counter(WORDS.findall(text.lower()))
    seen = np.zeros(len(names))
    total = 0
    for w, n in words.items():
        total += n
        if w in names:
            seen[names[w]] += n
        for k in PREFIXES:
            if len(w) >= k and (key := w[:k] + "*") in names:
                seen[names[key]] += n
    return np.concatenate([seen >= 1, seen >= 2, seen >= 3, np.minimum(100 * seen / max(total, 1), 3), np.log1p(patterns(text)) * 0.2])


def sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """t and y (0 or 1) of at most `rows` labelled texts, chosen by hash, with nr, their order."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_i")).agg(F.max(F.col(label_col) > 0).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("_i"), "_i").limit(rows)  # a bounded number of ids
    d = docs.select(F.col(id_col).alias("_i"), F.coalesce(text_col, F.lit("")).alias("t"))
    return staged(d.join(F.broadcast(chosen), "_i").groupBy("_i").agg(F.min("t").alias("t"), F.max("y").alias("y")).select(F.col("_i").cast("long").alias("nr"), "t", "y"))


def entry_counts(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """For each word and word beginning the numbers of clean (c1) and toxic (t1) texts that hold it, and that hold it twice (c2, t2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([x[i] for x in held.values()], pa.int64()) for i in range(4))], names=["w", "c1", "t1", "c2", "t2"])
            held.clear()
            return out

        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for w, n in counts(t.as_py()).items():
                    x = held.setdefault(w, [0, 0, 0, 0])
                    x[y] += 1
                    x[2 + y] += n >= 2
                if len(held) > most:
                    yield rows()
        yield rows()

    sums = texts.select("t", "y").mapInArrow(run, "w string, c1 long, t1 long, c2 long, t2 long")
    return sums.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("c1", "t1", "c2", "t2")])


def gain(hit: Column, miss: Column, pos: int, neg: int) -> Column:
    """Log-likelihood that knowing a vote adds, for votes that speak for toxic; else 0."""
    part = lambda k, n, p: F.when(k > 0, k * F.log(k / n / p)).otherwise(0.0)
    base, n, m = pos / (pos + neg), hit + miss, pos + neg - hit - miss
    return F.when((hit >= 4) & (hit * neg > 3 * miss * pos), part(hit, n, base) + part(miss, n, 1 - base) + part(pos - hit, m, base) + part(neg - miss, m, 1 - base)).otherwise(0.0)


def per_text(texts: DataFrame, make: Callable[[str], bytes]) -> list[bytes]:
    """make(text) of each text, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(t.as_py()) for t in b.column(1)], pa.binary())], names=["nr", "x"])

    return [bytes(r[1]) for r in sorted(texts.select("nr", "t").mapInArrow(run, "nr long, x binary").collect())]


def lexicon(texts: DataFrame, pos: int, neg: int, voters: int) -> dict[str, int]:
    """At most `voters` entries that speak for toxic, each marking other texts than those before it."""
    best = F.greatest(gain(F.col("t1"), F.col("c1"), pos, neg), gain(F.col("t2"), F.col("c2"), pos, neg))
    ranked = [r[0] for r in entry_counts(texts).where("t1 >= 4").withColumn("gain", best).where("gain >= 6").orderBy(F.desc("gain"), F.length("w"), "w").limit(20 * voters).collect()]
    place = {w: i for i, w in enumerate(ranked)}
    held: list[set[int]] = [set() for _ in ranked]
    for nr, raw in enumerate(per_text(texts, lambda t: np.array([place[w] for w in counts(t) if w in place], "<i4").tobytes())):
        for i in np.frombuffer(raw, "<i4").tolist():
            held[i].add(nr)
    names: dict[str, int] = {}
    for w in ranked:
        # a longer or shorter form of a chosen entry that marks nearly the same texts would be the same voter again
        own = held[place[w]]
        if len(names) < voters and all(len(own & held[place[k]]) < 0.8 * len(own | held[place[k]]) for k in names if k[:4] == w[:4]):
            names[w] = len(names)
    return names


def fit(docs: DataFrame, labels: DataFrame, rows: int = 5000, voters: int = 150, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """The classifier learned from at most `rows` labelled texts with at most `voters` lexicon entries; None without both labels."""
    texts = sample(docs, labels, rows, id_col, text_col, label_col)
    y = np.array([r[1] for r in sorted(texts.select("nr", "y").collect())], int)
    if not len(y) or y.min() == y.max():
        return None
    names = lexicon(texts, int(y.sum()), int(len(y) - y.sum()), voters)
    x = np.array([np.frombuffer(raw, "<f4") for raw in per_text(texts, lambda t: features(t, names).astype("<f4").tobytes())], float)
    m = len(names)
    shown = x[:, 4 * m :]
    votes = np.column_stack([x[:, : 2 * m], shown > np.quantile(shown, 0.98, axis=0)]).astype(float)
    posterior, model = label_model(votes, y)
    return {"names": names, "weights": logistic(x, posterior), "label_model": model}


def chance(text: str | None, model: dict | None) -> float:
    """The model's score of one text."""
    if not model:
        return 0.0
    x = features(text or "", model["names"])
    return float(1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -30, 30))))


def clean(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject (score below 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `voters` entries
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([chance(t.as_py(), shared.value) < 0.5 for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every row, and the lexicon entries that it holds (voters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `voters` entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = list(m["names"]) if m else []
        for b in batches:
            scores, found = np.zeros(b.num_rows), []
            for k, t in enumerate(b.column(1)):
                if m:
                    x = features(t.as_py() or "", m["names"])
                    scores[k] = 1 / (1 + np.exp(-np.clip(x @ m["weights"][:-1] + m["weights"][-1], -30, 30)))
                    found.append([names[j] for j in np.flatnonzero(x[: len(names)])])
                else:
                    found.append([])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "score", "predicted", "voters"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, score double, predicted int, voters array<string>")
