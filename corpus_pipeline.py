"""A training-data pipeline in five stages, each a table that the next one reads.

Quality classifier, near-duplicate removal, pseudonyms, source mixture, tokens. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import encode, jaccard, mixing, pii, quality
from helixframe.llm.common import scratch, shared_folder
from helixframe.llm.queries import TOKENIZER, secret


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates the document with the smallest id."""
    return jaccard.one_of_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms for personal data; n_chars follows the text."""
    hidden = pii.pseudonymize(docs, secret(spark))
    return hidden.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mixture has it."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left."""
    coded = encode.bpe_encode(docs.select("doc_id", "source", "text"), TOKENIZER, keep_text=False)
    return coded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", drop_near_duplicates), ("PII", hide_personal_data), ("mixing sources", mix_sources), ("BPE encoding", tokenize)]

#: A model, classes of near duplicates and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    A stage's own intermediate tables are deleted once it is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
