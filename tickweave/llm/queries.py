"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann_multi_index, chat_format, fill_in_middle, hnsw_dedup, langid, line_quality, minhash_dedup, packing, periodic_runs, sentencepiece_lattice, toxicity, url_filter, warc,
)
from .common import crc_mod, larger_tasks, new_folder, read

#: The url lists of op2: (rule, verdict).
URL_RULES = [
    ("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"),
]


def word_tokenizer() -> str:
    """Default of the tokenizer's path; callers elsewhere pass their own."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    """Default of the SentencePiece model's path; callers elsewhere pass their own."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=4)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text (word marks in it count as spaces)."""
    encoded = sentencepiece_lattice.encode(larger_tasks(read(spark, sf_dir, "documents")), piece_model())
    back = sentencepiece_lattice.decode(encoded, piece_model())
    same = F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


def op4_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_multi_index.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    index = warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 3) == 1).alias("held_out"))
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    weights = toxicity.fit(docs.where("not held_out").join(labels, "doc_id"))
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(read(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod("doc_id", 4) == 2).alias("held_out"))
    counts = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), counts).select("doc_id", "held_out", "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(larger_tasks(read(spark, sf_dir, "documents")), word_tokenizer())


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which about a tenth repeat a stretch of their own words up to the end.

    With h the crc32 of the id, g = floor(h / 10) and n words: where h % 10 is 0 and n > 0,
    each word i from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    Rows without id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    g, n = F.floor(h / 10), F.size("w").cast("long")
    a = g % n
    p = F.floor((n - a) / (3 + g % 8)) + 1
    planted = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    planted = planted.select("doc_id", "text", "w", n.alias("n"), F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.array_join(F.transform(at, lambda i: F.get("w", i.cast("int"))), " ")
    return planted.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    best = found.select("doc_id", "runs", "collapsed", periodic_runs.strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(periodic_runs.runs_text(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality.clean_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_approximate_neighbours": op4_approximate_neighbours,
    "op5_warc": op5_warc,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality_rules": op12_quality_rules,
    "op13_fill_in_middle": op13_fill_in_middle,
}
