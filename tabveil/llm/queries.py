"""Queries over the tables of a folder: one for each operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabveil.llm.common import small_batches


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tabveil.llm import toxicity

    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from tabveil.llm import decontaminate

    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")


def op1_substring(spark: SparkSession, folder: str) -> DataFrame:
    from tabveil.llm import substring

    return substring.without_repeats(table(spark, folder, "documents"))


def op3_neardup(spark: SparkSession, folder: str) -> DataFrame:
    from tabveil.llm import neardup

    return neardup.clusters(table(spark, folder, "documents"))


def op2_lines(spark: SparkSession, folder: str) -> DataFrame:
    from tabveil.llm import lines

    return lines.report(table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    from tabveil.llm import quality

    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    from tabveil.llm import chat

    return chat.formatted(table(spark, folder, "conversations"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    from tabveil.llm import pii

    return pii.report(table(spark, folder, "documents"))


def op6_ann(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tabveil.llm import ann

    return ann.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tabveil.llm import packing

    return packing.packed(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from tabveil.llm import chat, sql

    return {"op1_substring": sql.SUBSTRING, "op2_lines": sql.LINES, "op3_neardup": sql.NEARDUP, "op4_chat": chat.SQL, "op9_decontaminate": sql.DECONTAMINATE}
