"""A corpus pipeline of five stages, each the decision of one operator; every stage is written and read again.

All columns of documents pass through the first four stages; the last returns what encoding and decoding gave. Each
stage takes nulls, empty tables, repeated rows and extra columns as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, exact_dedup, mixing, simhash, toxicity
from loomwright.session import new_path, passing, remove


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above 0.3 go; labels of the training fold are what the grammar learns from."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that pairs of 0.8 or more in five-word shingles connect, the row with the smallest doc_id stays."""
    return simhash.drop_near_copies(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that sources come near their target weights."""
    return mixing.apply_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256, one row for each row of the mix."""
    keyed = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    found = bpe.encode_documents(keyed, id_col="key", form="text")
    return found.select("key.doc_id", "key.source", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mix_sources", mixing_stage),
    ("bpe_encode_decode", encoding_stage),
]
#: A learned grammar, hashes of shingles and byte-pair merges are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; what stands between them is a Parquet table in the shared folder, deleted when it has been read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
