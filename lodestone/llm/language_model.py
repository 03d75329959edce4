"""Texts scored by prediction by partial matching over bytes, beside a smoothed word model; both learn from all training texts.

A symbol is a byte of the text, A-Z lower-cased, or the end; its contexts are the 0 to `order` symbols before it, with the text's start as a symbol. The trie is a
table: a row for each context and symbol, keyed by both packed into a long of nine bits a symbol, so the key of the next shorter context is the key without its
highest symbol. A context seen in training gives a symbol of its own n / (t + d), where t is how often it was seen and d how many symbols it has; it escapes
with d / (t + d) (with 0 if it has all symbols) to the next shorter one, from which the symbols it has are excluded; below the empty context, the symbols not seen
yet share what is left. So the probabilities of all symbols in a context add up to 1.

Texts are dealt into batches by size as they are first read. Each batch counts its distinct contexts and words, in slices, so memory follows the slice; Spark adds
up the counts of all batches, works out each distinct row's code length, from the shortest contexts up, by joins on the shorter key and windows over one context,
of 258 rows at most, and joins it back to the batches that asked. Only then do texts move, once, to meet their own batch's rows. Nothing is broadcast or
collected but two totals.

Defined results: a null text counts as empty, an empty one is its end alone, predicted at the start; repeated rows count and are scored each; without training
rows every symbol has the probability 1/257 and every word 1; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import staged

BITS, END, SYMBOLS = 9, 257, 257
SLICE = 1 << 20
#: word: null in rows of packed symbols; n: how often training texts of the batch hold it.
UNITS = "batch long, word binary, gram long, n long"
SCORES = "n_tokens long, n_known long, n_bytes long, word_sum double, score double"


def batched(size: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lower-cased texts, and a number for each run of about `size` bytes, another for each partition."""
        number, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            texts, out = [t.lower() for t in b.column("text").to_pylist()], []
            for t in texts:
                if held and held + len(t) > size:
                    number, held = number + 1, 0
                held += len(t)
                out.append(number)
            arrays = [b.column("row"), b.column("train"), pa.array(texts, pa.binary()), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "train", "text", "batch"])

    return deal


def packed(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed contexts and symbols of texts, ends included, and the number of each one's text."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    gaps = np.repeat(np.arange(1, len(texts) + 1) * order, lengths)
    symbol = np.zeros(int(lengths.sum()) + order * len(texts), np.int64)
    at = np.arange(len(gaps)) + gaps
    symbol[at] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    symbol[at[np.cumsum(lengths) - 1]] = END
    key = symbol.copy()
    for k in range(1, order + 1):
        key[k:] |= symbol[:-k] << (BITS * k)
    return key[at], np.repeat(np.arange(len(texts)), lengths)


def slices(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """packed(), for about a million symbols at a time; a longer text goes through in parts that know what came before."""
    start = 0
    while start < len(texts):
        stop, held = start, 0
        while stop < len(texts) and (stop == start or held + len(texts[stop]) < SLICE):
            held += len(texts[stop]) + 1
            stop += 1
        if held <= 2 * SLICE:
            key, text = packed(texts[start:stop], order)
            yield key, text + start
        else:
            long = texts[start]
            for k in range(0, len(long) + 1, SLICE):
                before = max(k - order, 0)
                key, _ = packed([long[before : k + SLICE]], order)
                key = key[k - before :] if k + SLICE > len(long) else key[k - before : -1]
                yield key, np.full(len(key), start)
        start = stop


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bool]]]:
    """Consecutive rows of one batch number: their texts, and which of them train."""
    number, texts, train = None, [], []
    for b in batches:
        for n, t, learn in zip(b.column("batch").to_pylist(), b.column("text").to_pylist(), b.column("train").to_pylist(), strict=True):
            if n != number and texts:
                yield number, texts, train
                texts, train = [], []
            number = n
            texts.append(t)
            train.append(learn)
    if texts:
        yield number, texts, train


def counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch's distinct words and packed symbols, with their counts in its training texts."""
        for number, texts, train in runs(batches):
            learn = np.array(train)
            words, seen = Counter(), set()
            keys, counts = [], []
            for t, yes in zip(texts, train, strict=True):
                if yes:
                    words.update(t.split())
                else:
                    seen.update(t.split())
            for key, text in slices(texts, order):
                code, distinct = pd.factorize(key)
                keys.append(distinct)
                counts.append(np.bincount(code, weights=learn[text], minlength=len(distinct)).astype(np.int64))
                if len(keys) > 8:
                    keys, counts = merged(keys, counts)
            (keys,), (counts,) = merged(keys, counts)
            names = sorted(words.keys() | seen)
            rows = len(names) + len(keys)
            arrays = [
                pa.array(np.full(rows, number)),
                pa.array([*names, *[None] * len(keys)], pa.binary()),
                pa.array(np.concatenate([np.zeros(len(names), np.int64), keys]), mask=np.arange(rows) < len(names)),
                pa.array(np.concatenate([np.array([words[w] for w in names], np.int64), counts])),
            ]
            whole = pa.RecordBatch.from_arrays(arrays, ["batch", "word", "gram", "n"])
            for k in range(0, rows, 1 << 16):
                yield whole.slice(k, 1 << 16)

    return count


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    code, distinct = pd.factorize(np.concatenate(keys))
    total, order = np.bincount(code, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64), np.argsort(distinct)
    return [distinct[order]], [total[order]]


def code_lengths(counted: DataFrame, order: int) -> DataFrame:
    """gram, value: the log10 probability of each row's symbol in its context; counted: gram, n (0: not seen in training)."""
    asked = [counted]
    for k in range(order, 0, -1):
        asked.append(staged(asked[-1].groupBy((F.col("gram").bitwiseAND((1 << BITS * k) - 1)).alias("gram")).agg(F.sum("n").alias("n"))))
    below = None
    for k, rows in enumerate(reversed(asked)):
        if below is None:  # the empty context: what it leaves is shared by the symbols it has not
            rows = rows.withColumns({"ctx": F.lit(0).cast("long"), "n1": F.lit(1).cast("long"), "t1": F.lit(SYMBOLS).cast("long"), "d1": F.lit(SYMBOLS).cast("long"), "tail1": F.lit(0.0), "q1": F.lit(-float(np.log10(SYMBOLS)))})
        else:
            lower = below.select(F.col("gram").alias("short"), F.col("n").alias("n1"), F.col("t").alias("t1"), F.col("d").alias("d1"), F.col("tail").alias("tail1"), F.col("q").alias("q1"))
            rows = rows.withColumns({"short": F.col("gram").bitwiseAND((1 << BITS * k) - 1), "ctx": F.shiftright("gram", BITS)}).join(lower, "short")
        own = Window.partitionBy("ctx")  # at most one row a symbol
        seen = F.col("n") > 0
        rows = rows.withColumns({"t": F.sum("n").over(own), "d": F.sum(seen.cast("long")).over(own), "both": F.coalesce(F.sum(F.when(seen, F.col("n1"))).over(own), F.lit(0))})
        # after an escape: the shorter context, without the symbols that this one has
        rest_t, rest_d = F.col("t1") - F.col("both"), F.col("d1") - F.col("d")
        if below is None:
            tail = -F.log10((SYMBOLS - F.col("d")).cast("double"))
        else:
            total = (rest_t + F.when(F.col("d1") == SYMBOLS, 0).otherwise(rest_d)).cast("double")
            tail = F.when(F.col("n1") > 0, F.log10(F.col("n1") / total)).otherwise(F.when(rest_d > 0, F.log10(rest_d / total)).otherwise(0.0) + F.col("tail1"))
        total = (F.col("t") + F.when(F.col("d") == SYMBOLS, 0).otherwise(F.col("d"))).cast("double")
        q = F.when(F.col("t") == 0, F.col("q1")).when(seen, F.log10(F.col("n") / total)).otherwise(F.log10(F.col("d") / total) + F.col("tail"))
        rows = rows.withColumn("tail", F.when(~seen, tail)).withColumn("q", q)
        below = rows.select("gram", "n", "t", "d", "tail", "q")
    return below.select("gram", F.col("q").alias("value"))


def scorer(order: int, keep: list[str], total: float):
    def score(key: tuple, texts: pa.Table, rows: pa.Table) -> pa.Table:
        """A batch's texts with sums over their words and symbols, looked up in the batch's own rows."""
        words = rows.filter(pc.is_valid(rows.column("word")))
        found = dict(zip(words.column("word").to_pylist(), words.column("value").to_pylist(), strict=True))
        grams = rows.filter(pc.is_valid(rows.column("gram"))).select(["gram", "value"]).to_pandas().drop_duplicates("gram").sort_values("gram")
        known, value = grams["gram"].to_numpy(), grams["value"].to_numpy()
        whole = texts.column("text").to_pylist()
        sums = np.zeros(len(whole))
        for packed_keys, text in slices(whole, order):
            code, distinct = pd.factorize(packed_keys)
            sums += np.bincount(text, weights=value[np.searchsorted(known, distinct)][code], minlength=len(whole))
        tokens, hits, base = [], [], []
        for t in whole:
            own = t.split()
            c = np.fromiter(map(found.__getitem__, own), float, len(own))
            tokens.append(len(c) + 1)
            hits.append(int((c > 0).sum()))
            base.append(float(np.log10((c + 1) / total).sum()))
        out = [*(texts.column(n) for n in keep), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(t) for t in whole], pa.int64()), pa.array(base, pa.float64()), pa.array(sums)]
        return pa.table(out, names=[*keep, "n_tokens", "n_known", "n_bytes", "word_sum", "score"])

    return score


def scores(docs: DataFrame, text: Column, train: Column, keep: list[Column], order: int = 4, batch_bytes: int = 32 << 20) -> DataFrame:
    """The columns `keep` of every row with n_tokens, n_known, train_tokens, base_score (the word model's log10 probability), score (that of partial matching)
    and n_bytes. train: which rows the models learn from; order: symbols of context, 6 at most.
    """
    given = docs.select(F.struct(*keep).alias("row"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    given = staged(given.mapInArrow(batched(batch_bytes), StructType([*given.schema.fields, StructField("batch", LongType())])))
    units = staged(given.select("batch", "train", "text").mapInArrow(counter(order), UNITS))
    words, grams = units.where(F.col("word").isNotNull()), units.where(F.col("word").isNull())
    word_counts = staged(words.groupBy("word").agg(F.sum("n").alias("n")))
    gram_counts = staged(grams.groupBy("gram").agg(F.sum("n").alias("n")))
    ends = given.where("train").count()
    told = word_counts.where(F.col("n") > 0).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = told[0] + ends, told[1] + (ends > 0)
    back = words.join(word_counts.withColumnRenamed("n", "value"), "word").select("batch", "word", F.lit(None).cast("long").alias("gram"), F.col("value").cast("double"))
    back = back.unionByName(grams.join(code_lengths(gram_counts, order), "gram").select("batch", F.lit(None).cast("binary").alias("word"), "gram", "value"))
    asked = given.select("batch", "row", "text")
    kind = StructType([given.schema["row"], *StructType.fromDDL(SCORES).fields])
    done = asked.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(scorer(order, ["row"], float(total + kinds + 1)), kind)
    end = float(np.log10((ends + 1) / (total + kinds + 1)))
    base = F.col("word_sum") + F.lit(end)
    return done.select("row.*", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes")
