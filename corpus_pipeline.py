"""A training corpus from `documents`: language ID, near-duplicates, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a
DataFrame; it is written as Parquet and read again as the next one's documents. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayframe.llm import decontaminate, language_id, minhash_dedup, mixing, token_store
from stayframe.llm._stage import ensure_package, new_path
from stayframe.llm.queries import END_ID, WINDOW, table, tokenizer_path

#: A text whose best language has a lower probability is of no known language (short clean texts can come near 0.3).
#: Never so with four languages or fewer: texts unlike every language are rejected by language_id's floors.
MIN_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without a letter, and texts of no known language."""
    ensure_package(spark)
    model = language_id.fit(docs, F.col("lang").isNotNull() & F.col("doc_id").isNotNull(), floors=True)
    return language_id.keep_known(docs, model, MIN_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of near-duplicates."""
    ensure_package(spark)
    return minhash_dedup.keep_first(docs, size=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    ensure_package(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), WINDOW)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: one row per document and epoch in which some were taken."""
    ensure_package(spark)
    return mixing.mixed_documents(docs, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in compressed shards, read back: doc_id, start, n_tokens, ids_crc32."""
    ensure_package(spark)
    path = new_path(spark, "token-store")
    token_store.write_store(docs, path, tokenizer_path("word_bpe_49k.json"), END_ID)
    return token_store.read_store(spark, path)


STAGES = [
    ("language_id", language),
    ("minhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mix),
    ("token_store", token_shards),
]

#: A trained network, sampled signatures and drawn blocks have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
