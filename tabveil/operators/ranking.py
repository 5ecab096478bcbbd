"""Global ranks without a single task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 12


def ranked(df: DataFrame, bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its 1-based place by (bucket, order). bucket: a whole number under BUCKETS that rises with the order."""
    rows = df.withColumn("_b", bucket.cast("int"))
    offsets = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(offsets.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")))  # at most BUCKETS rows
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return rows.withColumn("_r", own).join(offsets, "_b").withColumn(name, (F.col("_r") + F.col("_o")).cast("long")).drop("_b", "_r", "_o")


def by_hash(df: DataFrame, h: Column, name: str = "rank") -> DataFrame:
    """Places by a hexadecimal hash, whose first three digits are even buckets."""
    return ranked(df, F.conv(F.substring(h, 1, 3), 16, 10), [h], name)


def by_number(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Places by a whole number; the buckets divide its range evenly."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    width = max(1, -(-(int(high) - int(low) + 1) // BUCKETS))
    return ranked(df, F.floor((F.col(column) - F.lit(int(low))) / F.lit(width)), [F.col(column)], name)
