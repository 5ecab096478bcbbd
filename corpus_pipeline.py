"""A training corpus from `documents`: each stage is written as Parquet, and the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabveil.llm import decontaminate, lines, neardup, packing, toxicity
from tabveil.llm.common import aside, small_batches, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, fitted on the labels, does not score as toxic."""
    small_batches(spark)
    return toxicity.rejected(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates and without repeated long lines, each but in its first document; n_chars follows the text.

    A document that would lose over half of its words is a copy and stays whole, for the next stage to judge.
    """
    own, back = aside(docs, ["n_lines", "n_dropped", "_gone", "_doc", "_key"])
    return _with_length(lines.dropped(own, copies=0.5).drop("n_lines", "n_dropped").withColumnsRenamed(back), docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    gone = neardup.clusters(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of the benchmark; n_chars follows the text."""
    return decontaminate.removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 1024 ids."""
    return packing.packed(docs)


def _with_length(out: DataFrame, docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


STAGES = [("toxicity", without_toxic), ("line dedup", without_recurring_lines), ("near-dedup", without_near_copies), ("decontamination", without_benchmark), ("packing", packed)]

#: No stage but the second can be stated in SQL; tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
