"""What of the source is still in the release: unchanged cells, shared values, values without a replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.functions import values as V
from tabveil.operators.distribution import long_form


def unchanged(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(col, unchanged): non-empty cells whose trimmed source equals the trimmed release. pairs: name -> (source, released), side by side."""
    same = lambda s, r: ~V.is_empty(V.trimmed(F.col(s))) & (V.trimmed(F.col(s)) == V.trimmed(F.col(r)))
    counts = df.agg(*[F.count_if(same(s, r)).alias(c) for c, (s, r) in pairs.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("unchanged")) for c in pairs])).alias("x")).select("x.*")


def residual(df: DataFrame, source: list[str], released: list[str]) -> DataFrame:
    """protected_values, released_values, overlap: distinct values of protected source columns, of all released ones, and of both."""
    # As the rule has it: the untrimmed cell decides whether it is empty, its trimmed text what is compared.
    distinct = lambda cols: long_form(df, cols).where(~V.is_empty(F.col("value"))).select(V.trimmed(F.col("value")).alias("value"))
    both = distinct(source).withColumn("side", F.lit(1)).union(distinct(released).withColumn("side", F.lit(2)))
    seen = both.groupBy("value").agg(F.bool_or(F.col("side") == 1).alias("a"), F.bool_or(F.col("side") == 2).alias("b"))
    return seen.agg(F.count_if("a").alias("protected_values"), F.count_if("b").alias("released_values"), F.count_if(F.col("a") & F.col("b")).alias("overlap"))


def missing(values: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (col, key) of values that the map `known` (col, key) lacks."""
    return values.select("col", "key").distinct().join(known.select("col", "key"), ["col", "key"], "left_anti")


def without_overlap(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Candidates (col, row, start, end, ...) that no span of the same cell overlaps."""
    s = spans.select(F.col("col").alias("_c"), F.col("row").alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (F.col("col") == F.col("_c")) & (F.col("row") == F.col("_r")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))
    return candidates.join(s, on, "left_anti")
