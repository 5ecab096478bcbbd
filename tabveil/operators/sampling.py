"""Deterministic samples: bottom-k by a hash of the position, the head, and even steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tabveil.operators import ranking


@F.pandas_udf(DecimalType(20, 0))
def splitmix64(position: pd.Series) -> pd.Series:
    """Unsigned 64-bit hash of a position; BIGINT would overflow, so numpy computes it in Arrow batches."""
    from decimal import Decimal

    x = position.to_numpy().astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return pd.Series([Decimal(int(v)) for v in x ^ (x >> np.uint64(31))])


def spread(df: DataFrame, position: str, k: int) -> DataFrame:
    """The k rows whose positions (0, 1, ...) hash lowest: a bounded heap in each task, then one of them."""
    return df.withColumn("_p", splitmix64(F.col(position))).orderBy("_p").limit(k).drop("_p")


def head(df: DataFrame, position: str, k: int) -> DataFrame:
    return df.orderBy(position).limit(k)


def even(df: DataFrame, order: str, k: int = 200) -> DataFrame:
    """Rows at floor(i * n / k) of the order, i < k; all rows if there are no more than k."""
    n = df.count()
    placed = ranking.by_number(df, order, "_place")
    if n <= k:
        return placed.drop("_place")
    wanted = df.sparkSession.range(k).select((F.floor(F.col("id") * n / k) + 1).cast("long").alias("_place"))
    return placed.join(F.broadcast(wanted), "_place").drop("_place")  # k rows
