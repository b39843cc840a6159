"""The corpus pipeline: each stage works on what the one before it kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import decontaminate, line_dedup, ngram_join, packing, quality_classifier
from evidentia.llm._shared import drop, fold, settle, table

#: The quality classifier and the packing of tokens are no SQL.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels outside the held-out fold."""
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"), fold(docs["doc_id"], 5) != 0)
    return quality_classifier.keep_good(docs, model)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text."""
    return line_dedup.with_length(line_dedup.remove_boilerplate(docs))


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, one stays."""
    return ngram_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with their ids. Fewer pieces are remembered than by default, and none afterwards: earlier stages have filled the executors."""
    return packing.pack(docs, with_ids=True, known=200_000, warm=False)


STAGES = [
    ("quality classifier", quality_stage), ("line dedup", lines_stage), ("n-gram Jaccard join", copies_stage),
    ("benchmark decontamination", benchmark_stage), ("packing", packing_stage)
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes when the next one's is written; the last one's is what the result reads."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
