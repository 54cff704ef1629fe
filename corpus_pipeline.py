"""A corpus pipeline: language ID, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last keep the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billsift.llm import bpe, common, decontamination, language_id, secrets, simhash


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; profiles are learnt from the labelled ones among them.

    Null, empty and letterless texts go, as they have no language. Where nothing is labelled there is nothing to
    recognise by, and all documents with a letter stay.
    """
    learnt = language_id.profiles(docs)
    return language_id.keep_identified(docs, learnt) if learnt else docs.where(F.col("text").rlike(r"\p{L}"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates; texts without words are such a component."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; those without words stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars brought up to date; a null text stays null."""
    return secrets.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' ids, and a digest of the text that they decode to: doc_id, lang, source, n_tokens, ids, decoded_sha256.

    A null or empty text has no ids, and decodes to the empty text.
    """
    tokenizer = bpe.default_tokenizer()
    found = bpe.round_trip_column(F.col("text"), tokenizer, bpe.lexicon(docs, tokenizer), spark)
    coded = docs.select("doc_id", "lang", "source", found.alias("found"))
    return coded.select(
        "doc_id", "lang", "source", F.size("found.ids").cast("long").alias("n_tokens"), "found.ids",
        F.sha2("found.decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify),
    ("near_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("secrets", hide_secrets),
    ("bpe", tokenize),
]

#: SQL has no XXH64 and no BPE; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
