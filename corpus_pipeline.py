"""A corpus pipeline of five stages; each is written as Parquet and read again ahead of the next.

Quality rules drop what they reject; near-duplicate groups keep the document with the
least doc_id; contaminated documents go; secrets are replaced in the text, which stays;
what is left is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontamination, quality, secrets, sentence_pieces, similar
from folioflow.llm.queries import tokenizer_path
from folioflow.runtime import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, and the text that the ids give back."""
    return sentence_pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "decoded")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: SQL can't express the learned references, the novelty or the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
