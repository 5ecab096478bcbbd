"""Fingerprints of source files, so that an analysis is used for the same bytes only."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes, start: int = FNV_OFFSET) -> int:
    for b in data:
        start = (start ^ b) * FNV_PRIME & (1 << 64) - 1
    return start


def files(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and contents of all files at a path, each hashed where it is read."""
    rows = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("h"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "h"))), "\n").cast("binary"), 256)).first()[0]
