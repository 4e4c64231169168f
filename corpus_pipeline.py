"""A pipeline of corpus operators over ``documents``: toxicity, exact and near de-duplication, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of
docs, whatever they are (doc_id, text and source are needed). Null texts count as empty; a null id comes after all others;
rows equal in doc_id and text stay or go together, but for exact copies, of which one row stays; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transect.llm import chunk_bpe, exact_dedup, mixing, simhash, toxicity
from transect.llm.common import delete_shared, shared_dir, table
from transect.llm.queries import WORD_BPE, remainder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 1 scores at 0.3 or more go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"), usable=remainder(4) != 2)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 3 bits or fewer join, the one with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources to equal weights; a document may occur several times from here on, or not at all."""
    return mixing.mix_sources(docs.select("doc_id", "source", F.struct("*").alias("row"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return chunk_bpe.summary(docs, WORD_BPE)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("SimHash near-dedup", drop_near_copies), ("mixing", mix), ("BPE", encode)]

#: Learned scores and SimHash have no SQL; tests hold every stage and the chain against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps is written to the shared folder and read again, and goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete_shared(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
