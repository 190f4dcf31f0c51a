"""The training-data pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all its predecessor kept; its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import line_dedup, mixing, packing, quality_rules, simhash
from lodestrata.llm.common import fresh, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    return quality_rules.keep_good(docs, quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand earlier go from the texts; n_chars follows. Documents stay, those without a line left with an empty text."""
    (extra,) = fresh(docs, "deleted")
    return line_dedup.dedup(docs, out=extra).drop(extra).withColumn("n_chars", F.length("text").cast("bigint"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights: some sources give a part of theirs, scarce ones give theirs in more than one epoch."""
    (extra,) = fresh(docs, "epoch")
    return mixing.mix(docs, mixing.source_domain(), mixing.DOMAINS, out=extra).drop(extra)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.packed(packing.cut(docs))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("mixing", mixture), ("packing", sequences)]

#: The learned rules, XXH64 fingerprints, token ids and the evolved packing have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
