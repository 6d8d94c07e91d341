"""A training corpus out of `documents`: toxic documents go, near duplicates go, repeated passages go, sources are mixed, texts are encoded.

Each stage runs on what the one before wrote. Defined cases: a null text is scored and encoded as empty, links with nothing and stays null; a null id stays, as
the largest; of repeated rows (equal id and text) one stays; rows with equal ids and different texts are judged as rows of their own; an
empty table gives no rows; extra columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, near_texts, repeats, toxicity
from tidemark.llm.common import materialise, release, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return near_texts.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that start earlier go; documents of which nothing is left go."""
    out = repeats.rewrite(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """95 % of the tokens, of one epoch, by the weights of the mixing query."""
    return mixing.keep_mixed(docs, mixing.domain_of(F.col("source")), 0.95, mixing.WEIGHTS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode(docs, digests=True)


STAGES = [("toxicity", toxicity_stage), ("minhash", minhash_stage), ("suffix", suffix_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: SQL can't express training, minhashing or BPE; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before wrote. A stage's scratch tables go when its result is written; the last one's go with common.release."""
    docs, others = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        release(spark, [*others, written()[-1]])
    return STAGES[-1][1](spark, docs, sf_dir)
