"""Subword tokenizers over text columns.

Texts are cut into words by an expression, the distinct words of the table are split into tokens once each (by a tokenizer's `split`, a small function of one word),
and sent to the blocks of texts that hold them, where the words of each text take their tokens in order; special tokens, truncation and padding are expressions
again. Of the many occurrences of a word only one for each block is shuffled, and the texts once.
"""

from __future__ import annotations

import functools
import heapq
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import InvalidConfiguration
from ..functions.text import basic_tokens, truncate
from ..sources.shared import written

SPACE_MARK = "▁"
MARKS = r"(?U)[\p{P}\p{S}]|[^\s\p{P}\p{S}]+"
#: Pre-tokenizer patterns by name; the first differs from its namesake in taking digits in groups of one to three.
PRE_TOKENIZERS = {
    "gpt2": r"'(?i:[sdmt])|'(?i:ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    "llama3": r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
}


@dataclass(frozen=True)
class Options:
    """What happens to the tokens of a text: special tokens, truncation, padding."""

    max_length: int = 512
    truncation: str = "end"
    padding: str = "none"
    special_tokens: bool = True


@functools.cache
def byte_letters() -> dict[int, str]:
    """The usual map of bytes to printable characters: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class Tokenizer:
    """Base: a vocabulary, special tokens (by role: cls, sep, pad, unk, mask, bos, eos) and what is common to all kinds."""

    vocabulary: dict[str, int]
    special: dict[str, str] = field(default_factory=dict)
    lowercase: bool = True
    unknown_id: int = 100

    def words(self, text: Column) -> Column:
        """The words of a text, as an array."""
        return F.regexp_extract_all(F.lower(text) if self.lowercase else text, F.lit(r"(?U)\S+"), F.lit(0))

    def split(self, word: str) -> list[str]:
        raise NotImplementedError

    @functools.cached_property
    def lengths(self) -> dict[str, list[int]]:
        """The lengths of the tokens that begin with the same two characters, or with the same two behind ##, longest first."""
        out: dict[str, set[int]] = {}
        for t in self.vocabulary:
            for mark in ("", "##"):
                if t.startswith(mark):
                    out.setdefault(mark + t[len(mark) :][:2], set()).add(len(t) - len(mark))
        return {start: sorted(some, reverse=True) for start, some in out.items()}

    def longest_at(self, word: str, at: int, mark: str = "") -> str | None:
        """The longest token that stands at a place of a word, or that stands there behind the mark."""
        for n in self.lengths.get(mark + word[at : at + 2], ()):
            if (token := mark + word[at : at + n]) in self.vocabulary:
                return token
        token = mark + word[at]
        return token if token in self.vocabulary else None

    @functools.cached_property
    def by_id(self) -> dict[int, str]:
        return {i: t for t, i in self.vocabulary.items()}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("lengths", "by_id")}

    def id_of(self, token: str) -> int:
        unknown = self.vocabulary.get(self.special.get("unk", ""), self.unknown_id)
        return self.vocabulary.get(token, unknown)

    def ends(self) -> tuple[list[str], list[str]]:
        """The special tokens before and behind a text."""
        first, last = self.special.get("cls", self.special.get("bos")), self.special.get("sep", self.special.get("eos"))
        return [first] * (first is not None), [last] * (last is not None)

    def known(self, ids: Sequence[int]) -> list[str]:
        """Tokens of the ids, without special ones (the unknown token stays)."""
        by_id = self.by_id
        hidden = {t for role, t in self.special.items() if role != "unk"}
        return [by_id[i] for i in ids if i in by_id and by_id[i] not in hidden]

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join(self.known(ids))


class WordPiece(Tokenizer):
    """Greedy longest match inside words; parts after the first are marked with ##. A word with a part that is not in the vocabulary, or of over 200 characters, is unknown."""

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text) if self.lowercase else text, F.lit(MARKS), F.lit(0))

    def split(self, word: str) -> list[str]:
        unknown = [self.special.get("unk", "[UNK]")]
        if len(word) > 200:
            return unknown
        out, at = [], 0
        while at < len(word):
            mark = "##" if at else ""
            token = self.longest_at(word, at, mark)
            if token is None:
                return unknown
            out.append(token)
            at += len(token) - len(mark)
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join(self.known(ids)).replace(" ##", "")


class SentencePiece(Tokenizer):
    """Words behind a boundary mark: whole if known, else greedy longest prefixes; a character that is not known is the unknown token."""

    def words(self, text: Column) -> Column:
        return F.transform(super().words(text), lambda w: F.concat(F.lit(SPACE_MARK), w))

    def split(self, word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            token = self.longest_at(word, at)
            out.append(self.special.get("unk", "[UNK]") if token is None else token)
            at += len(token or " ")
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return "".join(self.known(ids)).replace(SPACE_MARK, " ").removeprefix(" ")


@dataclass
class ByteBPE(Tokenizer):
    """Byte-level byte-pair encoding: the merge of lowest rank first, the leftmost of equal ones."""

    ranks: dict[tuple[str, str], int] = field(default_factory=dict)
    pattern: str = "gpt2"
    normalization: str | None = None
    prefix_space: bool = False
    unknown_id: int = 0

    def words(self, text: Column) -> Column:
        t = normalized(text, F.lit(self.normalization.upper())) if self.normalization else text
        return F.regexp_extract_all(F.concat(F.lit(" "), t) if self.prefix_space else t, F.lit("(?U)" + PRE_TOKENIZERS.get(self.pattern, self.pattern)), F.lit(0))

    def split(self, word: str) -> list[str]:
        letters = byte_letters()
        return self.merge([letters[b] for b in word.encode()])

    def merge(self, parts: list[str]) -> list[str]:
        """Merges by a heap of (rank, place) over a linked list; stale entries are skipped."""
        n = len(parts)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.ranks[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], live[j], after[i] = parts[i] + parts[j], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (p := (parts[a], parts[b])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p], a, p))
        return [p for p, ok in zip(parts, live, strict=True) if ok]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids; empty if their bytes are not UTF-8."""
        back = {c: b for b, c in byte_letters().items()}
        try:
            return bytes(back[c] for c in "".join(self.known(ids)) if c in back).decode()
        except UnicodeDecodeError:
            return ""


@dataclass
class GreedyBPE(Tokenizer):
    """The older kind: merges from left to right without ranks, staying in place after each."""

    merges: dict[tuple[str, str], str] = field(default_factory=dict)

    def split(self, word: str) -> list[str]:
        own: list[str] = []
        for c in word:  # the part before the place is settled, so only its last piece can take the next character
            if own and (own[-1], c) in self.merges:
                c = self.merges[own.pop(), c]
            own.append(c)
        return own


@F.pandas_udf(StringType())
def normalized(text: pd.Series, form: pd.Series) -> pd.Series:
    """Unicode normalization, which no expression has."""
    return text.map(lambda t: unicodedata.normalize(form.iat[0], t), na_action="ignore")


#: Characters of the texts that meet their own words in one block, about.
BLOCK = 8 << 20
SPLIT = "word string, blocks array<long>, tokens array<string>"


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) with a number for each run of texts of about BLOCK characters, another for each partition."""
    block, held = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        out = []
        for size in pc.binary_length(b.column("text")).to_pylist():
            if held and held + size > BLOCK:
                block, held = block + 1, 0
            held += size
            out.append(block)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], ["id", "text", "block"])


def split_words(words: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(word, blocks, tokens) of distinct words (word, blocks)."""
    own = words.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [own.value.split(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("blocks"), pa.array(parts, pa.list_(pa.string()))], ["word", "blocks", "tokens"])

    return words.select("word", "blocks").mapInArrow(run, SPLIT)


def put_together(texts: pa.Table, words: pa.Table, tokenizer: Tokenizer) -> pa.Table:
    """id, ids, tokens of the texts (id, words) of a block, with the block's distinct words (word, tokens)."""
    starts = lambda lists: np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    own = texts.column("words").combine_chunks()
    at = pc.index_in(own.flatten(), value_set=words.column("word").combine_chunks())
    parts = words.column("tokens").combine_chunks().take(at)
    tokens = parts.flatten().dictionary_encode()
    ids = pa.array([tokenizer.id_of(t) for t in tokens.dictionary.to_pylist()], pa.int32()).take(tokens.indices)
    ends = pa.array(starts(parts)[starts(own)], pa.int32())
    return pa.table({"id": texts.column("id"), "ids": pa.ListArray.from_arrays(ends, ids), "tokens": pa.ListArray.from_arrays(ends, parts.flatten())})


def encode(rows: DataFrame, tokenizer: Tokenizer, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids, tokens, mask of each row; null text counts as empty. max_length 0: no truncation or padding."""
    if options.padding == "max" and options.max_length and "pad" not in tokenizer.special:
        raise InvalidConfiguration("padding needs a pad token")
    source = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    # written once, as a text's block must not change between the jobs
    source = written(source.mapInArrow(in_blocks, f"id {kind}, text string, block long"))
    held = source.select("block", F.explode(tokenizer.words(F.col("text"))).alias("word")).distinct()
    split = split_words(held.groupBy("word").agg(F.collect_list("block").alias("blocks")), tokenizer)  # a word has a block at most once
    split = split.select(F.explode("blocks").alias("block"), "word", "tokens")
    own = rows.sparkSession.sparkContext.broadcast(tokenizer)
    # dealt and sorted as texts, which take less room than their words
    texts = source.repartition("block").sortWithinPartitions("block").select("block", "id", tokenizer.words(F.col("text")).alias("words"))
    out = texts.groupBy("block").cogroup(split.groupBy("block")).applyInArrow(lambda left, right: put_together(left, right, own.value), f"id {kind}, ids array<int>, tokens array<string>")
    kind = {"ids": "array<int>", "tokens": "array<string>"}
    array = lambda values, k: F.array(*[F.lit(v) for v in values]).cast(kind[k])
    before, behind = tokenizer.ends() if options.special_tokens else ([], [])
    ends = {"tokens": (before, behind), "ids": ([tokenizer.id_of(t) for t in before], [tokenizer.id_of(t) for t in behind])}
    pad = {"tokens": tokenizer.special.get("pad"), "ids": tokenizer.id_of(tokenizer.special.get("pad", ""))}
    for k in ("ids", "tokens"):
        t = F.concat(array(ends[k][0], k), F.col(k), array(ends[k][1], k))
        out = out.withColumn(k, truncate(t, options.max_length, options.truncation) if options.max_length else t)
    out = out.withColumn("mask", F.array_repeat(F.lit(1), F.size("ids")))
    if options.padding == "max" and options.max_length:
        more = F.lit(options.max_length) - F.size("mask")
        out = out.select("id", *[F.concat(k, F.array_repeat(F.lit(v), more)).alias(k) for k, v in (*pad.items(), ("mask", 0))])
    return out.select(F.col("id").alias(id_col), "ids", "tokens", "mask")


def decode(rows: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    own = rows.sparkSession.sparkContext.broadcast(tokenizer)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.value.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=[id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def learned_vocabulary(rows: DataFrame, size: int, special: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """Special tokens, then the `size` most frequent basic tokens (ties in order of the token), then single characters, plain and marked, seen in them."""
    top = rows.select(F.explode(basic_tokens(text_col)).alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(size).collect()
    words = [r[0] for r in top]
    letters = sorted({c for w in words for c in w})
    return {t: i for i, t in enumerate(dict.fromkeys([*special, *words, *letters, *("##" + c for c in letters), SPACE_MARK, *(SPACE_MARK + w for w in words)]))}
