"""Synthetic values of a type, from a seed: the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.functions import values as V

MOST = 1000
STRATEGIES = ("auto", "pseudonymize", "tokenize", "localAi")
TYPES = "email phone firstName lastName fullName ipAddress url macAddress timestamp numericId numericValue postalCode taxId currency percentage address countryCode enum uuid boolean string".split()


def _number(h: Column, at: int, low: int, high: int) -> Column:
    return (V.hash_number(h, at, 7) % (high - low + 1) + low).cast("string")


def _digits(h: Column, at: int, n: int) -> Column:
    return F.translate(F.substring(h, at, n), "abcdef", "012345")


def _choice(h: Column, at: int, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (V.hash_number(h, at, 7) % len(values) + 1).cast("int"))


def expression(kind: str, h: Column) -> Column:
    c = F.concat
    lit, num, dig, hexed = F.lit, (lambda a, lo, hi: _number(h, a, lo, hi)), (lambda a, n: _digits(h, a, n)), (lambda a: F.substring(h, a, 2))
    two = lambda a, lo, hi: F.lpad(num(a, lo, hi), 2, "0")
    return {
        "email": lambda: c(lit("person"), num(1, 1, 999999), lit("@example.invalid")),
        "phone": lambda: c(lit("555-020-"), dig(1, 4)),
        "firstName": lambda: c(lit("First"), num(1, 1, 9999)),
        "lastName": lambda: c(lit("Last"), num(1, 1, 9999)),
        "fullName": lambda: c(lit("First"), num(1, 1, 9999), lit(" Last"), num(9, 1, 9999)),
        "ipAddress": lambda: c(lit("198.51.100."), num(1, 1, 254)),
        "url": lambda: c(lit("https://example.invalid/"), _choice(h, 1, ["item", "page", "note", "file"]), lit("/"), num(9, 1, 9999)),
        "macAddress": lambda: c(lit("02:00:"), hexed(1), lit(":"), hexed(3), lit(":"), hexed(5), lit(":"), hexed(7)),
        "timestamp": lambda: c(lit("2024-"), two(1, 1, 12), lit("-"), two(9, 1, 28), lit("T"), two(17, 0, 23), lit(":"), two(25, 0, 59), lit(":00Z")),
        "numericId": lambda: num(1, 100000, 999999),
        "numericValue": lambda: c(num(1, 1, 9999), lit("."), dig(9, 2)),
        "postalCode": lambda: dig(1, 5),
        "taxId": lambda: c(lit("900-"), dig(1, 2), lit("-"), dig(3, 4)),
        "currency": lambda: c(lit("$"), num(1, 1, 9999), lit("."), dig(9, 2)),
        "percentage": lambda: c(num(1, 0, 99), lit("."), dig(9, 1), lit("%")),
        "address": lambda: c(num(1, 1, 999), lit(" "), _choice(h, 9, ["Maple", "Harbor", "Mill", "Station"]), lit(" "), _choice(h, 17, ["Street", "Road", "Lane"]), lit(", "), _choice(h, 25, ["Easton", "Weston", "Norton"])),
        "countryCode": lambda: _choice(h, 1, ["NL", "DE", "FR", "GB", "US", "ES", "IT", "BE"]),
        "enum": lambda: _choice(h, 1, ["alpha", "beta", "gamma", "delta", "epsilon"]),
        "uuid": lambda: c(F.substring(h, 1, 8), lit("-"), F.substring(h, 9, 4), lit("-4"), F.substring(h, 14, 3), lit("-8"), F.substring(h, 18, 3), lit("-"), F.substring(h, 21, 12)),
        "boolean": lambda: _choice(h, 1, ["true", "false"]),
        "string": lambda: c(lit("sample-"), num(1, 1, 9999), lit("-"), F.substring(h, 9, 8)),
    }[kind]()


def generated(spark: SparkSession, kind: str, n: int, seed: str = "") -> DataFrame:
    """(i, value) of n values, 1 to 1000."""
    if not 1 <= n <= MOST or kind not in TYPES:
        raise ValueError(f"1 to {MOST} values of a known type")
    return spark.range(n).select(F.col("id").alias("i"), expression(kind, F.sha2(F.concat_ws("\u0001", F.lit(seed), F.lit(kind), F.col("id").cast("string")).cast("binary"), 256)).alias("value"))
