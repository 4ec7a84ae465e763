"""The corpus pipeline: four training-data operators, one after the other, over ``documents``.

Toxic documents go, then those without a recognisable language, then all but one of each
group of near-duplicates; what is left is packed into training sequences. Every stage but
the last returns the columns of its input; the last returns one row per packed piece.
Nulls, repeated rows, empty tables and extra columns behave as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import langid, minhash_dedup, packing, toxicity
from tickweave.llm.common import new_folder, read
from tickweave.llm.queries import word_tokenizer

#: A prediction below this share of the languages' softmax is no language.
LEAST_LANGUAGE_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; fitted on the labelled ones."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    weights = toxicity.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    score = toxicity.score(docs.select(F.struct("*").alias("doc")), weights, ("doc", "text"))
    return score.where(F.col("score") < toxicity.THRESHOLD).select("doc.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; fitted on the documents' own ``lang``."""
    counts = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.predict(docs.select(F.struct("*").alias("doc")), counts, ("doc", "text"))
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash_dedup.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: A fitted classifier, MinHash and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    folder = new_folder(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{at}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
