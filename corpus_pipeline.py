"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of documents.
Every stage lets the session hand texts to Python in small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontam, packing, quality, simhash, toxicity
from pairloom.llm.common import in_parts, read, small_batches, written
from pairloom.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic.

    Null and empty texts have no terms and go or stay by the bias. Repeated rows are judged alike,
    a score of just 0.5 is toxic, an empty table stays empty; ids only tie labels to texts.
    """
    small_batches(spark)
    vocab, params = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), vocab, params) < 0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are at least as likely as not of grade 1 or better.

    Null and empty texts go or stay by the thresholds alone. Repeated rows are judged alike, a
    chance of just one half stays, an empty table stays empty; ids only tie labels to texts.
    """
    small_batches(spark)
    grade = quality.grade_of(F.col("quality"), F.col("toxic"))
    vocab, params = quality.fit(docs, read(spark, sf_dir, "labels"), grade, 3)
    return docs.where(quality.score(F.col("text"), vocab, params)["tail_prob"] >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    The links of a group are of SimHash fingerprints of five words in a row that differ in three
    bits at most. Texts without words are one group; of repeated rows one stays, of a group
    without ids too; an empty table stays empty.
    """
    small_batches(spark)
    return simhash.one_of_each(docs, shingle=5)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts hold none and stay, so do all rows beside an empty benchmark. Repeated
    rows are judged alike, whatever their ids.
    """
    small_batches(spark)
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences.

    Null and empty texts are of one token, the end. Every repeated row has a place of its own, null
    ids are kept, an empty table gives no rows.
    """
    small_batches(spark)
    return in_parts(packing.pack_documents(docs, TOKENIZER), docs.count())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
