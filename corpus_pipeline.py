"""Cleans a corpus and mixes it: the stages run in order, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import forget, spare, tidy, written
from lodestar.llm.decontaminate import drop_contaminated
from lodestar.llm.exact import DigestIndex, drop_exact
from lodestar.llm.mixing import mix_rows
from lodestar.llm.quality import drop_poor
from lodestar.llm.simhash import drop_near


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null texts are scored as empty ones, rows without an id
    by their own text; rows that are alike stand or fall together; an empty table stays empty."""
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one without an id only among its like, and of
    rows that are alike a single one; null texts are empty ones; an empty table stays empty."""
    index = DigestIndex(spark)
    try:
        return drop_exact(docs, index, batch="documents")
    finally:
        index.close(delete=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (SimHash fingerprints at most two bits apart, by operator 7's trie, or 0.8
    of their five-word shingles in common, and chains of such pairs) the smallest doc_id stays, a row without an id only in a group without any; texts without
    words, null ones too, are one group; an empty table stays empty."""
    return drop_near(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with the benchmark go.  Null texts share none; rows without
    an id go by their own text; rows that are alike go together; an empty table stays empty."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of documents, each as often as the mix takes it, with the number of the copy (copy_no, or
    copy_no_ if documents has such a column).  Rows that are alike come from one, their copies added up;
    texts without words can be taken too, and add none; a null source is one of its own; an empty table
    stays empty."""
    copies, nr = spare(docs, "copies", "copy_no")
    return mix_rows(docs, copies=copies).withColumn(nr, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(copies)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mix_stage),
]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of documents that the mix takes, after all stages; nulls, repeated rows and empty tables as
    each stage says.  Each stage's result is a table in the shared folder; what the stage wrote on the
    way, and the table it read, are deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with tidy(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
            keep(docs)
        forget(before)
    return docs
