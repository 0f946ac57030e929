"""Corpus pipeline: five stages, each an operator of ``wagelens.llm``.

Every stage takes (spark, docs, sf_dir) and returns the documents that it
keeps, with the columns of documents; the last returns the shard of each row.
``run`` writes each stage's rows as Parquet to the shared folder and reads them
back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagelens.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from wagelens.llm.common import shared, table

#: near duplicates: words of a shingle and the similarity, as a fraction
SHINGLE, SIMILAR = 5, (8, 10)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, the predicted one as ``lang``; those without a letter (``und``) go."""
    return language_id.with_language(docs, language_id.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id."""
    return jaccard_join.keep_one(docs, SHINGLE, *SIMILAR)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, and the leading words of the document at a source's boundary."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix, with the size and crc of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return sharding.shuffle_to_shards(docs.select(
        "doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32")))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: language, similarity, latent retrieval and hashes are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None
