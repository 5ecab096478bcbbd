"""How values repeat in columns, and whether pseudonyms could be told by their frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.functions import values as V

#: Fewest values, distinct values, share, coverage and ratio of the rule.
FLOOR, FEW, DOMINANT_THIRDS, COVERAGE_QUARTERS, LARGE_PERCENT = 50, 10, 1, 3, 5
#: Mapping entries for each distinct value by strategy; and when a projection asks for a review.
ENTRIES = {"label": 1, "tokenize": 3, "localAi": 3, "auto": 3, "pseudonymize": 3, "mask": 0, "redact": 0, "passThrough": 0}
REVIEW_ENTRIES = 3_000_000


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value): one row for each cell, in one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, key, n) over identity keys, without empty values."""
    cells = long_form(df, columns).withColumn("value", V.trimmed(F.col("value")))
    return cells.where(~V.is_empty(F.col("value"))).groupBy("col", V.identity_key(F.col("value")).alias("key")).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """col, distinct_values, total_values, singleton_values, doubleton_values, max_value_occurrences."""
    return value_counts(df, columns).groupBy("col").agg(
        F.count("*").alias("distinct_values"), F.sum("n").alias("total_values"), F.count_if(F.col("n") == 1).alias("singleton_values"), F.count_if(F.col("n") == 2).alias("doubleton_values"), F.max("n").alias("max_value_occurrences")
    )


def chao1(d: Column, f1: Column, f2: Column) -> Column:
    """Distinct values that the sample implies, unseen ones included; whole numbers."""
    exact = lambda x: x.cast("decimal(38,0)")
    return (d + F.when(f2 > 0, F.floor(exact(f1) * exact(f1) / (2 * exact(F.greatest(f2, F.lit(1)))))).otherwise(F.floor(exact(f1) * exact(F.greatest(f1 - 1, F.lit(0))) / 2))).cast("long")


def with_risk(stats: DataFrame, population: Column | None = None) -> DataFrame:
    """stats with estimated_distinct and risk (none, fewDistinctValues, dominantValue, largeGroups)."""
    d, n, f1, f2, top = (F.col(c) for c in ("distinct_values", "total_values", "singleton_values", "doubleton_values", "max_value_occurrences"))
    population = n if population is None else population
    out = stats.withColumn("estimated_distinct", chao1(d, f1, f2))
    risk = (
        F.when(n < FLOOR, "none")
        .when(d < FEW, "fewDistinctValues")
        .when(3 * top >= DOMINANT_THIRDS * n, "dominantValue")
        .when(4 * (n - f1) < COVERAGE_QUARTERS * n, "none")
        .when(100 * F.col("estimated_distinct") < LARGE_PERCENT * F.greatest(population, F.lit(1)), "largeGroups")
        .otherwise("none")
    )
    return out.withColumn("risk", risk)


def projected_distinct(stats: DataFrame, rows: int) -> DataFrame:
    """stats with projected_distinct: what a file of `rows` rows may hold."""
    d, n, f1, f2 = (F.col(c) for c in ("distinct_values", "total_values", "singleton_values", "doubleton_values"))
    grown = chao1(d, f1, f2) + F.floor(F.lit(rows).cast("decimal(38,0)") * f1 / F.greatest(n, F.lit(1))).cast("long")
    return stats.withColumn("projected_distinct", F.when(n == 0, F.lit(0)).when(n >= rows, d).otherwise(F.least(F.lit(rows), grown)).cast("long"))


def mapping_projection(stats: DataFrame, rows: int, strategies: dict[str, str]) -> DataFrame:
    """entries over all mapping columns, and whether that many ask for a review."""
    per = F.create_map(*[F.lit(x) for c, s in strategies.items() for x in (c, ENTRIES[s])])
    total = projected_distinct(stats, rows).agg(F.coalesce(F.sum(F.col("projected_distinct") * F.coalesce(per[F.col("col")], F.lit(0))), F.lit(0)).cast("long").alias("entries"))
    return total.withColumn("review", F.col("entries") >= REVIEW_ENTRIES)
