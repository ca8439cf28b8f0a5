"""Corpus cleaning: toxicity, line dedup, near-dedup, decontamination and encoding, one after the other.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of ``documents``,
the last one the encoded documents. ``run`` writes each stage as Parquet and rereads it, so a lost executor costs part
of a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrail.llm import bpe, decontaminate, lines, near
from caretrail.llm import toxicity as toxic
from caretrail.llm.common import documents, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by examples among ``docs`` that ``labels`` marks."""
    model = toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct("*").alias("row"))
    return toxic.scored(rows, model, keep=("row",), text="row.text").where("score < 0.5").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one up to two edits."""
    return lines.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, decoded of every document."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"), fields=("ids", "n_tokens", "decoded"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

ORACLE_SQL = None  # scores and token ids are beyond SQL: tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
