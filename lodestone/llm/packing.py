"""Packing token sequences into fixed windows by non-negative least squares.

A document of n tokens yields n // window whole windows and one remainder. Remainders are counted in an exact
histogram (at most window - 1 numbers). Shallow combinations of length bins that fill a window are enumerated, their
repeat counts solved by NNLS against the binned histogram and rounded down; what remains is packed greedily end to end,
cut where a window is full. The plan is a few small arrays whatever the size of the corpus: a document finds its
place from its rank among the remainders of its length, which comes from per-partition counts and a prefix sum.

Defined results: null text counts as empty (one end token); repeated rows are packed each; an empty table gives no
rows; columns besides the id and the text are ignored; very long texts span many windows.
"""

from __future__ import annotations

import array
import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Words in each of the two generations of a worker's table.
CACHED_WORDS = 400_000
#: Sequence ids of whole windows start here, those of the plan below.
WHOLE = 1 << 36


#: Letters, and ASCII punctuation behind them: lower-case words of this form the normalizer leaves alone and the pre-tokenizer cuts in these two.
PLAIN = re.compile(r"([^\W\d_]*)([!-/:-@\[-`{-~]*)")
#: The byte alphabet of the pre-tokenizer: printable bytes stand for themselves, the others for characters from 256 on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
LETTERS = {b: (b if b in PRINTED else 256 + sum(x not in PRINTED for x in range(b))) for b in range(256)}


class WordTokenizer:
    """Ids of a tokenizer that lower-cases, never merges over ASCII white space and marks each word's last id, with the ids of each word kept.

    A word goes through the tokenizer's own normalizer, pre-tokenizer and model one by one, which saves what a whole encoding costs besides; words that may hold a
    special token are encoded as a whole. The table has two generations: what is asked for moves to the young one, which becomes the old one when it is full, so
    frequent words stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        t = self.tokenizer
        norm, cut, tokenize = t.normalizer.normalize_str, t.pre_tokenizer.pre_tokenize_str, t.model.tokenize
        for w in words:
            text = w.decode()
            if "<|" in text:
                ids = t.encode(text, add_special_tokens=False).ids
            elif (m := PLAIN.fullmatch(text)) and (text.isascii() or (m[1].isalpha() and unicodedata.is_normalized("NFC", text))) and text == text.lower():
                ids = [x.id for part in m.groups() if part for x in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(LETTERS))]
            else:
                ids = [x.id for part, _ in cut(norm(text)) for x in tokenize(part)]
            self.young[w] = array.array("I", ids).tobytes()

    def ids(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if "<|" in text:  # special tokens are not to come about
            words = text.encode("utf-8", "replace").split()
        elif text.isascii():
            words = text.lower().encode().split()
        elif "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low := text.lower()):
            words = low.encode("utf-8", "replace").split()  # there is nothing to compose before or after
        else:  # the normalizer composes words before it lower-cases them, and a final sigma depends on its place
            words = [w.lower() if w.isascii() else w for w in text.encode("utf-8", "replace").split()]
        if new := set(words).difference(self.young):
            unknown = []
            for w in new:
                if (v := self.old.get(w)) is None:
                    unknown.append(w)
                else:
                    self.young[w] = v
            if unknown:
                self.learn(unknown)
        out = b"".join(map(self.young.__getitem__, words))
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        return out


@functools.lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> WordTokenizer:
    """A Python worker's own, which keeps its words from task to task."""
    return WordTokenizer(path)


TOKENS = "doc_id long, n long, ids binary, part int, pos int, rem int, rank int, whole long"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document: its ids, its place in the partition and its rank among remainders of its length there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, pos, whole, seen = worker_tokenizer(tokenizer), TaskContext.get().partitionId(), 0, 0, {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for k in range(batch.num_rows):
                ids = own.ids(batch.column(1)[k].as_py()) + end
                n = len(ids) // 4
                rem = n % window
                rows.append((batch.column(0)[k].as_py(), n, ids, part, pos, rem, seen.get(rem, 0), whole))
                seen[rem] = seen.get(rem, 0) + 1
                pos, whole, held = pos + 1, whole + n // window, held + len(ids)
                if held > 16 << 20:
                    yield packed(rows)
                    rows, held = [], 0
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        names = [x.split()[0] for x in TOKENS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, TOKENS)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """argmin |a x - b| over x >= 0 by the active-set method of Lawson and Hanson."""
    x, passive, ata, atb = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool), a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, np.abs(atb).max(initial=0))
    for _ in range(rounds):
        w = np.where(passive, -np.inf, atb - ata @ x)
        if w.max(initial=-np.inf) <= tol:
            break
        passive[np.argmax(w)] = True
        while True:
            on = np.flatnonzero(passive)
            s = np.linalg.lstsq(ata[np.ix_(on, on)], atb[on], rcond=None)[0]
            if s.min(initial=1) > 0:
                break
            low = s <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - s[low], 1e-300))
            x[on] += step * (s - x[on])
            passive[on[x[on] <= tol * 1e-3]] = False
            x[~passive] = 0
        x[:] = 0
        x[on] = s
    return x


def combinations(bins: int) -> list[tuple[int, ...]]:
    """All ways to fill `bins` units with one to three parts, largest first."""
    pairs = [(a, bins - a) for a in range((bins + 1) // 2, bins)]
    triples = [(a, b, bins - a - b) for a in range(1, bins) for b in range(1, a + 1) if 1 <= bins - a - b <= b]
    return [(bins,), *pairs, *triples]


class Plan:
    """Where a remainder goes, from its length and its rank among the remainders of that length."""

    def __init__(self, counts: np.ndarray, window: int, bins: int):
        """counts: remainders by length, 0 to window - 1 (0 is ignored)."""
        self.window, unit = window, max(1, window // bins)
        length = np.arange(window)
        counts = np.where(length > 0, counts, 0).astype(np.int64)
        self.bin = -(-length // unit)
        held = np.bincount(self.bin, counts, bins + 1).astype(np.int64)
        combos = combinations(bins)
        a = np.zeros((bins + 1, len(combos)))
        for j, c in enumerate(combos):
            for p in c:
                a[p, j] += 1
        x = nnls(a, held.astype(float) / max(1, held.max())) * max(1, held.max()) if held.any() else np.zeros(len(combos))
        used, at = np.zeros(bins + 1, np.int64), 0
        places: list[list[tuple[int, int, int, int]]] = [[] for _ in range(bins + 1)]
        for j in np.argsort(-x, kind="stable"):
            need = {p: combos[j].count(p) for p in combos[j]}
            times = min(int(x[j] + 0.5), *((held[p] - used[p]) // m for p, m in need.items()))
            if times > 0:
                for p, m in need.items():
                    places[p].append((int(used[p]), at, combos[j].index(p), m))
                    used[p] += times * m
                at += int(times)
        self.places = [np.array(p or [(1 << 62, 0, 0, 1)], np.int64) for p in places]
        before = np.cumsum(counts) - counts  # remainders that are shorter
        first = np.concatenate([[0], np.cumsum(np.bincount(self.bin, counts, bins + 1).astype(np.int64))[:-1]])
        self.in_bin = before - first[self.bin]  # the rank in its bin of a length's first
        self.planned = np.clip(used[self.bin] - self.in_bin, 0, counts)  # of a length, so many are in combinations
        left = counts - self.planned
        self.start = np.cumsum(left * length) - left * length  # of the residuals, end to end
        self.sequences = at

    def place(self, rem: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces of the remainder: start and length in it, sequence, order there."""
        if rank < self.planned[rem]:
            k = rank + int(self.in_bin[rem])
            t = self.places[self.bin[rem]]
            begin, at, slot, m = (int(v) for v in t[np.searchsorted(t[:, 0], k, "right") - 1])
            return [(0, rem, at + (k - begin) // m, slot + (k - begin) % m)]
        out, pos, done = [], int(self.start[rem] + (rank - self.planned[rem]) * rem), 0
        while done < rem:
            n = min(rem - done, self.window - pos % self.window)
            out.append((done, n, self.sequences + pos // self.window, pos % self.window))
            pos, done = pos + n, done + n
        return out


PIECE = "array<struct<start: long, length: long, sequence_id: long, slot: long>>"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, bins: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces that fill windows: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, little-endian).

    window: tokens in a sequence; bins: length classes of the least-squares plan. Every id is in exactly one piece and the
    offsets in a sequence have no gaps.
    """
    t = staged(tokenized(docs, tokenizer, end_id, window, id_col, text_col))
    met = t.where("rem > 0").groupBy("rem", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(window, np.int64)
    for rem, n in met.groupBy("rem").agg(F.sum("n")).collect():  # fewer rows than a window has tokens
        counts[rem] = n
    plan = Plan(counts, window, bins)
    base = met.select("rem", "part", (F.sum("n").over(Window.partitionBy("rem").orderBy("part")) - F.col("n")).alias("base"))
    out_kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "sequence_id", "slot")]))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.to_pydict()
            pieces = []
            for n, part, rem, rank, whole, before in zip(col["n"], col["part"], col["rem"], col["rank"], col["whole"], col["base"], strict=True):
                own = [(k * window, window, (part + 1) * WHOLE + whole + k, 0) for k in range(n // window)]
                if rem:
                    own += [(n - rem + s, m, seq, slot) for s, m, seq, slot in plan.place(rem, rank + before)]
                pieces.append([dict(zip(("start", "length", "sequence_id", "slot"), p, strict=True)) for p in own])
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("pos"), pa.array(pieces, out_kind)], names=["part", "pos", "pieces"])

    meta = t.select("n", "part", "pos", "rem", "rank", "whole").join(base, ["rem", "part"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    pieces = meta.mapInArrow(placed, f"part int, pos int, pieces {PIECE}").select("part", "pos", F.inline("pieces"))
    gapless = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("offset", F.coalesce(gapless, F.lit(0)))
    own = pieces.groupBy("part", "pos").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))

    # each piece is cut out of its document's ids before the pieces become rows, so a long document is not copied for each
    part = lambda p: F.substring("ids", (4 * p["start"] + 1).cast("int"), (4 * p["length"]).cast("int"))
    cut = F.transform("pieces", lambda p: F.struct(*[p[c].alias(c) for c in ("start", "length", "sequence_id", "offset")], part(p).alias("ids")))
    rows = t.select("part", "pos", "doc_id", "n", "ids").join(own, ["part", "pos"]).select("doc_id", F.col("n").alias("doc_tokens"), F.inline(cut))
    return rows.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
