"""A corpus pipeline: quality rules, near copies, long repeats, benchmark leaks, mixing.

Each stage takes the table that the one before it left and returns the columns of
``documents``; the last leaves what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontaminate, mixture, ngram_join, quality_rules, suffix_dedup
from linkloom.llm._workspace import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality_rules.filter_docs(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of five-word Jaccard 0.8 or more."""
    return ngram_join.keep_one(docs.select(*COLUMNS), k=5, num=4, den=5)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that 200-byte repeats cover (50 words of three letters); those with nothing left go."""
    return suffix_dedup.strip_repeats(docs.select(*COLUMNS), length=200)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.filter_docs(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text that the mix takes of each document; documents that give nothing go."""
    return mixture.mix_texts(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", long_repeats),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", mix),
]

#: EM, linked components and banded alignment are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Workspace(spark, "pipeline") as ws:
        for name, stage in STAGES[:-1]:
            docs = ws.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return ws.finish(STAGES[-1][1](spark, docs, sf_dir))  # checkpointed, so the tables may go
