"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last keep the columns of documents, and further columns of any names; the last says in which shard each row is.

Documents without a text, or with an empty one, are neither toxic nor copies of others with another id nor contaminated, and the mix, which is
counted in words, takes none of them. Rows without an id are never copies of others. Rows that are equal in id and text
stay once. An empty table gives no rows in every stage. Ties: of a group of copies the smallest id stays, then the smallest
hash of its shingles, then the smallest text; a score of exactly 0.5 is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyra.llm import jaccard, leaks, mixing, shards, toxicity
from papyra.llm.store import Scratch

#: Some stages can't be said in SQL (a trained classifier, hashed shingles); tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay, all columns as they are; empty texts get the bias alone."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go, and documents that consist of them for more than half."""
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks; the rest goes."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row is: doc_id, shard, shard_bytes, version."""
    return shards.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table is deleted when the next one's is written."""
    tables, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        written = tables.cut(stage(spark, docs, sf_dir), "stage")
        tables.drop(docs)
        docs = written
    return docs
