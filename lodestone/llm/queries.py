"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, digests, language_model, languages, manifest, mixing, neighbours, oracles, packing, pseudonyms, secret_scan, simhash, toxicity, warc
from .common import scratch_path, ship, table

#: The key of the pseudonyms: from the environment, so that runs agree; else drawn anew for this process, and links hold within its runs alone.
PII_KEY = os.environ.get("LODESTONE_PII_KEY") or secrets.token_hex(32)
WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, "mix"
ASSIGN = secret_scan.PATTERNS[0][1]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows of an Arrow batch: whole texts of any length then fit a worker's memory. Also ships the code that workers run."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def remainder(n: int):
    """crc32(doc_id as text) mod n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pieces = packing.with_crc(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, window=4096))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    m = mixing.mix(docs, WEIGHTS, REPEATS, SEED, size=F.col("words")).orderBy("virtual_finish")
    return m.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("virtual_finish", 6).alias("virtual_finish"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = languages.fit(docs.where(remainder(4) != 2), key=F.col("doc_id"))
    found = languages.predict(docs, model)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "languages")


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    done = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "text", F.size("pii_spans").alias("n_replaced"), "pii_spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.edited_likeness(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = scratch_path(spark)
    warc.write(table(spark, sf_dir, "pages"), path, segment=4096)
    return warc.read(spark, path, payload=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder(5) != 0))
    return toxicity.score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "voters")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ordinary = secret_scan.identifiers(docs)
    model = secret_scan.train(secret_scan.random_strings(), ordinary)
    threshold = secret_scan.threshold_of(model, secret_scan.random_strings(1400, seed=3), secret_scan.joined_forms(ordinary, 1000, seed=99))
    return secret_scan.report(secret_scan.scan(docs, model, threshold))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return neighbours.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    scored = language_model.scores(docs, F.col("text"), remainder(7) != 2, keep=[F.col("doc_id"), (remainder(7) == 2).alias("held_out")], order=4)
    exact = [F.round(c, 6).alias(c) for c in ("base_score", "score")]
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", *exact, "n_bytes")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    leaf = lambda n_chars: manifest.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0  # a null id is not hit
    shown = F.when(hit, leaf(F.col("n_chars") + 1)).alias("shown")
    proved = manifest.prove(docs, leaf(F.col("n_chars")), F.col("lang"), F.col("doc_id"), [F.col("doc_id"), shown])
    folded = proved.withColumn("folded_root", manifest.folded(F.coalesce("shown", "leaf"), F.col("path")))
    proof = manifest.digest_of(F.col("path")).alias("proof_sha256")
    return folded.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    coded = codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_mixing, op3_language, op4_pseudonyms, op5_simhash, op6_fingerprints, op7_warc, op8_toxicity, op9_secrets, op10_neighbours, op11_lm_scores, op12_manifest, op13_codes)}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.mix_sql(WEIGHTS, REPEATS, SEED),
    "op10_neighbours": oracles.NEIGHBOURS,
    "op11_lm_scores": oracles.language_model(order=4),
    "op12_manifest": oracles.MANIFEST,
    "op13_codes": oracles.codes(parts=4, entries=256, rounds=4, scale=1024, dimension=64),
}
