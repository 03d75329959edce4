"""Readers: vocabularies, merges, tokenizer files, model folders, relational tables; writers of exact vector blobs."""

from __future__ import annotations

import glob
import json
import os
import sqlite3
import struct
import uuid
from contextlib import closing

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType, StructType

from ..operators.tokenizers import ByteBPE, GreedyBPE, SentencePiece, WordPiece


def lines(spark: SparkSession, path: str) -> list[str]:
    """A small text file's lines in order, wherever Spark can read it."""
    return [r[0] for r in spark.read.text(path, wholetext=True).select("value").limit(1).collect()][0].splitlines()


def vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """One token a line, blank lines skipped; of a token that comes twice the last place counts."""
    return {t: i for i, t in enumerate(x.strip() for x in lines(spark, path) if x.strip())}


def piece_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """The first column of each line; comments and blank lines skipped."""
    return {t: i for i, t in enumerate(x.split()[0] for x in lines(spark, path) if x.strip() and not x.startswith("#"))}


def merges(spark: SparkSession, path: str) -> dict[tuple[str, str], int]:
    """Pairs by rank: the number of the line among those with two parts."""
    pairs = [tuple(x.split()) for x in lines(spark, path) if not x.startswith("#") and len(x.split()) == 2]
    return {p: i for i, p in enumerate(pairs)}


def wordpiece(spark: SparkSession, path: str, **how) -> WordPiece:
    return WordPiece(vocabulary(spark, path), **how)


def sentencepiece(spark: SparkSession, path: str, **how) -> SentencePiece:
    return SentencePiece(piece_vocabulary(spark, path), **how)


def greedy_bpe(spark: SparkSession, vocab_path: str, merges_path: str, **how) -> GreedyBPE:
    return GreedyBPE(vocabulary(spark, vocab_path), merges={p: "".join(p) for p in merges(spark, merges_path)}, **how)


#: Names by which a tokenizer file calls its special tokens, by role.
ROLES = {"cls": ("[CLS]", "<s>"), "sep": ("[SEP]", "</s>"), "pad": ("[PAD]", "<pad>"), "unk": ("[UNK]", "<unk>"), "mask": ("[MASK]", "<mask>"), "bos": ("<|begin_of_text|>", "<|startoftext|>"), "eos": ("<|end_of_text|>", "<|endoftext|>")}


def tokenizer_file(spark: SparkSession, path: str) -> ByteBPE:
    """A byte-level tokenizer from a tokenizer.json: vocabulary, added tokens, merges ranked by their place, normalizer, prefix space."""
    d = json.loads("\n".join(lines(spark, path)))
    vocab = dict(d["model"]["vocab"]) | {t["content"]: t["id"] for t in d.get("added_tokens", [])}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"].get("merges", [])]
    special = {role: next(n for n in names if n in vocab) for role, names in ROLES.items() if any(n in vocab for n in names)}
    parts = [d.get("normalizer") or {}, *((d.get("normalizer") or {}).get("normalizers") or [])]
    form = next((p["type"].lower() for p in parts if p.get("type") in ("NFC", "NFKC")), None)
    pre = [d.get("pre_tokenizer") or {}, *((d.get("pre_tokenizer") or {}).get("pretokenizers") or [])]
    own = next((p["pattern"]["Regex"] for p in pre if p.get("type") == "Split" and "Regex" in p.get("pattern", {})), "gpt2")
    return ByteBPE(vocab, special, lowercase=False, ranks={p: i for i, p in enumerate(pairs)}, pattern=own, normalization=form, prefix_space=any(p.get("add_prefix_space", False) for p in pre))


# Model folders.

#: Families by what their names hold (or begin with, or hold between dashes), in the order in which they are tried, with their usual dimension.
FAMILIES = (("minilm", "minilm|mini-lm", 384), ("distilbert", "distilbert", 768), ("mpnet", "mpnet", 768), ("roberta", "roberta", 768), ("bert", "bert", 768), ("sentence-transformers", "sentence-transformer|sbert", 384), ("e5", "-e5-|^e5-", 384), ("gte", "-gte-|^gte-", 384), ("bge", "-bge-|^bge-", 384))
#: Dimensions that a name may state, in the order in which they are tried; words of embedding models, and of general models that embed.
DIMENSIONS = (384, 256, 128, 768, 512, 1024)
EMBEDDING_WORDS = "embed|sentence|sbert|transformer|minilm|mpnet|e5-|gte-|bge-|paraphrase|multi-qa"
GENERAL_WORDS = "embed|sentence|encoder"


def model_family(name: Column) -> Column:
    """The first family whose pattern the name has, else null."""
    return F.coalesce(*[F.when(F.lower(name).rlike(p), F.lit(f)) for f, p, _ in FAMILIES])


def model_dimensions(name: Column) -> Column:
    """From a number behind a dash or underscore or at the end; from six or twelve layers; else the family's usual one."""
    n = F.lower(name)
    stated = [F.when(n.rlike(f"[-_]{d}|{d}$"), F.lit(d)) for d in DIMENSIONS]
    usual = F.coalesce(*[F.when(model_family(name) == f, F.lit(d)) for f, _, d in FAMILIES])
    return F.coalesce(*stated, F.when(n.rlike("l6|l12"), F.lit(384)), usual)


def is_embedding_model(name: Column) -> Column:
    general = F.coalesce(model_family(name).isin("bert", "distilbert", "roberta"), F.lit(False))
    return F.lower(name).rlike(EMBEDDING_WORDS) | (general & F.lower(name).rlike(GENERAL_WORDS))


def models(spark: SparkSession, path: str, least: int = 1024, embedding_only: bool = False) -> DataFrame:
    """Model files and package folders below path: path, name, type, size (of a folder: of all its files), modified, family, dimensions, is_embedding, by name. File contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    folder = F.regexp_extract("path", r"^(.*?\.mlpackage)/", 1)
    f = f.groupBy(F.when(folder != "", folder).otherwise(F.col("path")).alias("path")).agg(F.sum("size").alias("size"), F.max("modified").alias("modified"))
    name = F.regexp_extract("path", r"([^/]+)\.(mlpackage|mlmodel|onnx)$", 1)
    f = f.withColumn("name", name).withColumn("type", F.regexp_extract("path", r"\.(mlpackage|mlmodel|onnx)$", 1)).where((F.col("name") != "") & (F.col("size") >= least))
    f = f.withColumn("family", model_family(F.col("name"))).withColumn("dimensions", model_dimensions(F.col("name"))).withColumn("is_embedding", is_embedding_model(F.col("name")))
    return (f.where("is_embedding") if embedding_only else f).orderBy("name", "path")


def matching(found: DataFrame, part: str) -> DataFrame:
    return found.where(F.lower("name").contains(part.lower()))


# Vectors as bytes.


def float_blob(values) -> bytes:
    """Little-endian 32-bit floats."""
    return np.asarray(values, "<f4").tobytes()


def from_float_blob(raw: bytes) -> list[float]:
    return np.frombuffer(raw, "<f4").tolist()


def int8_blob(scale: float, offset: float, low: float, high: float, codes) -> bytes:
    """Sixteen bytes of parameters, then a byte for each code."""
    return struct.pack("<4f", scale, offset, low, high) + np.asarray(codes, np.int8).tobytes()


def from_int8_blob(raw: bytes) -> tuple[float, float, float, float, list[int]]:
    return (*struct.unpack("<4f", raw[:16]), np.frombuffer(raw[16:], np.int8).tolist())


@F.pandas_udf(BinaryType())
def float_blobs(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else float_blob(x))


@F.pandas_udf(ArrayType(FloatType()))
def from_float_blobs(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else from_float_blob(x))


@F.pandas_udf(ArrayType(FloatType()))
def float16(v: pd.Series) -> pd.Series:
    """Each vector as half floats give it back."""
    return v.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))


# Relational files.


#: What SQLite calls the storage classes, and the types they become.
STORED = {"integer": "bigint", "real": "double", "text": "string", "blob": "binary"}


def sqlite_files(path: str) -> list[str]:
    return sorted(glob.glob(os.path.join(path, "*.db"))) if os.path.isdir(path) else [path]


def sqlite_survey(spark: SparkSession, paths: list[str], query: str, key: str | None) -> tuple[str, dict[str, tuple]]:
    """The query's columns as DDL, and the least and greatest integer key by file, surveyed by a task for each file: SQLite itself tells which classes each column
    holds; mixed numbers become double, other mixtures text. The driver gets a row for each file and column."""

    def survey(batches):
        for batch in batches:
            for p in batch["path"]:
                with closing(sqlite3.connect(f"file:{p}?mode=ro", uri=True)) as con:
                    names = [c[0] for c in con.execute(f"select * from ({query}) limit 0").description]
                    bounds = f"min(\"{key}\") filter (where typeof(\"{key}\") = 'integer'), max(\"{key}\") filter (where typeof(\"{key}\") = 'integer')" if key else "null, null"
                    low, high, *classes = con.execute(f"select {bounds}, " + ", ".join(f'group_concat(distinct typeof("{c}"))' for c in names) + f" from ({query})").fetchone()
                yield pd.DataFrame([(p, i, c, k or "", low, high) for i, (c, k) in enumerate(zip(names, classes, strict=True))], columns=["path", "at", "name", "classes", "low", "high"]).astype({"low": "Int64", "high": "Int64"})

    tasks = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    seen: dict[str, set] = {}
    bounds: dict[str, tuple] = {}
    for r in sorted(tasks.mapInPandas(survey, "path string, at int, name string, classes string, low long, high long").collect(), key=lambda r: (r["path"], r["at"])):
        seen.setdefault(r["name"], set()).update(r["classes"].split(","))
        bounds[r["path"]] = (r["low"], r["high"])
    kind = lambda k: STORED[min(k)] if len(k) == 1 else "double" if k == {"integer", "real"} else "string"
    return ", ".join(f"`{c}` {kind(k - {'', 'null'})}" for c, k in seen.items()), bounds


def read_sqlite(spark: SparkSession, path: str, query: str, key: str | None = None, schema: str | None = None, step: int = 50_000) -> DataFrame:
    """Rows of a query on a database file, or on every *.db file of a folder (write_sqlite), read by tasks; the path must be shared with the executors.

    With an integer column `key` of the query, each `step` of its values is read by a task of its own (keys that are null or no integer with the first);
    without, a task streams a file's rows in batches. Column types come from the file unless a schema is given. No rows give an empty table.
    """
    paths = sqlite_files(path)
    found, bounds = sqlite_survey(spark, paths, query, key) if paths and (key or not schema) else ("", {})
    ranges = []
    for p in paths:
        low, high = bounds.get(p, (None, None))
        ranges += [(p, None, None, True)] if low is None else [(p, k, min(k + step - 1, high), k == low) for k in range(low, high + 1, step)]
    schema = schema or found
    fields = StructType.fromDDL(schema)
    texts = [f.name for f in fields if f.dataType == StringType()]

    def read(batches):
        for batch in batches:
            for p, low, high, first in batch.itertuples(index=False):
                bounds = "" if low is None or pd.isna(low) else f"where \"{key}\" between {int(low)} and {int(high)} and typeof(\"{key}\") = 'integer'" + (f" or \"{key}\" is null or typeof(\"{key}\") <> 'integer'" if first else "")
                with closing(sqlite3.connect(f"file:{p}?mode=ro", uri=True)) as con:
                    cursor = con.execute(f"select * from ({query}) {bounds}")
                    while rows := cursor.fetchmany(10_000):
                        out = pd.DataFrame(rows, columns=fields.names, dtype=object)
                        for c in texts:
                            out[c] = out[c].map(lambda x: x if x is None or isinstance(x, str) else str(x))
                        yield out

    tasks = spark.createDataFrame(ranges, "path string, low long, high long, first boolean")
    return tasks.repartition(max(len(ranges), 1)).mapInPandas(read, fields)


def write_sqlite(df: DataFrame, path: str, table: str) -> int:
    """The rows into a table of database files, one for each partition, below the folder `path` that driver and executors share; gives the number of rows.

    A task builds its file under another name and renames it when whole, so a lost or repeated task leaves no half file. Arrays, maps and
    structs are written as JSON, dates and decimals as text.
    """
    plain = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string").alias(c) if t.startswith(("date", "timestamp", "decimal")) else F.col(c) for c, t in df.dtypes])
    names, marks = ", ".join(f'"{c}"' for c in plain.columns), ", ".join("?" * len(plain.columns))
    os.makedirs(path, exist_ok=True)

    def write(batches):
        part = TaskContext.get().partitionId()
        draft = os.path.join(path, f".part-{part:05d}-{uuid.uuid4().hex}")
        n = 0
        with closing(sqlite3.connect(draft)) as con:
            con.execute(f'create table "{table}" ({names})')
            for batch in batches:
                rows = zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)
                con.executemany(f'insert into "{table}" values ({marks})', rows)
                n += batch.num_rows
            con.commit()
        os.replace(draft, os.path.join(path, f"part-{part:05d}.db"))
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return plain.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
