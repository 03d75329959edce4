"""A training corpus from raw documents: toxic texts out, one of each group of near copies kept, personal data replaced, sources
mixed to target weights, the mixture packed into sequences. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all
but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, packing, pseudonyms, queries, simhash, toxicity
from lodestone.llm.common import staged, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows among them, does not reject. Null and empty texts are scored as empty ones; repeated rows are
    scored alike, and all stay or go; without labelled rows of both kinds, or documents, nothing is rejected."""
    queries.small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(queries.remainder(5) != 0))
    return toxicity.clean(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id (null ids last, then by text), of each group of likeness 0.8 or more in shingles of five words. Null and empty texts are
    one group; a row repeated whole stays once."""
    queries.small_batches(spark)
    return simhash.representatives(docs, shingle=5, likeness=0.8)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with validated numbers, dates and mail addresses in its text replaced by pseudonyms; nulls stay null, other columns as they are."""
    queries.small_batches(spark)
    return pseudonyms.pseudonymise(docs, queries.PII_KEY).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken. The last one that a source has served is cut at a word where the clock stops: its text and n_chars are those of the
    piece. Null sources are a source, null and empty texts have no words and are not taken; documents of one id are served in order of size and text, repeated rows
    each; no documents give no rows."""
    return mixing.mixed_rows(docs, weights=queries.WEIGHTS, repeats=queries.REPEATS, seed=queries.SEED)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids (little-endian unsigned 32-bit numbers) in sequences of at most 4096 tokens. A null or empty text is its end alone; repeated
    rows are packed each; without documents there are no pieces."""
    queries.small_batches(spark)
    return packing.pack(docs, queries.tokenizer_path(), end_id=2, window=4096)


STAGES = [("toxicity", without_toxic), ("near_copies", without_near_copies), ("personal_data", without_personal_data), ("mixing", mixture), ("packing", packed)]

#: The stages' models, hashes and tokenizer have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else staged(docs), sf_dir)
    return docs
