"""A corpus cleaning pipeline of the operators in scholion.llm.

Every stage takes what its predecessor kept and returns the columns of
documents; the last returns packed pieces.
"""

from pyspark.sql import DataFrame, SparkSession

from scholion.llm.decontamination import benchmark_hits, remove_spans
from scholion.llm.near_dedup import drop_near_duplicates
from scholion.llm.packing import pack
from scholion.llm.quality_rules import apply_quality_rules
from scholion.llm.suffix_dedup import remove_repeats
from scholion.runtime import checkpointed, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much."""
    return apply_quality_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id."""
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that an earlier document, or the same one before, holds are cut out."""
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of words that benchmark windows cover are cut out."""
    return remove_spans(benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenising, banded alignment and cut texts are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written as Parquet and read again by the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
