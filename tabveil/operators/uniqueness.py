"""What released rows still single out: classes of rows that agree on what an outsider could know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.functions import values as V

#: Fixed value: the smallest class that passes.
VERIFIED_FLOOR = 5
PASS_THROUGH = {"countryCode", "boolean", "currency", "percentage", "enum"}
NAMES = {"firstName", "lastName", "fullName"}


def _zeros(v: Column) -> Column:
    return F.length(v) - F.length(F.regexp_replace(v, "^0+", ""))


def projection(v: Column, kind: str, strategy: str, selected: bool = True) -> tuple[str, Column]:
    """(part, expression): what of the released value can be matched; null: nothing of it."""
    if not selected or strategy == "passThrough" or (strategy in ("auto", "pseudonymize") and kind in PASS_THROUGH):
        return "wholeValue", v
    if strategy == "mask":
        return "survivingFormat", v
    if strategy in ("tokenize", "label", "redact") or (strategy == "localAi" and kind in PASS_THROUGH):
        return "blankPattern", _blank(v)
    if kind == "email":
        return "emailDomain", F.when(F.contains(v, F.lit("@")), F.concat(F.lit("@"), F.substring_index(v, "@", -1)))
    if kind == "timestamp":
        parts = r"^([+-]?[0-9]{3,})[0-9]-[0-9]{2}-[0-9]{2}([\s\S]*)$"
        return "dateDecadeAndTime", F.when(v.rlike(parts), F.concat(F.regexp_extract(v, parts, 1), F.lit("|"), F.regexp_extract(v, parts, 2)))
    if kind == "phone":
        shaped = (F.length(V.digits(v)) >= 7) & v.rlike(r"^[0-9 ()+.\-xet#*,;/]+$")
        return "survivingFormat", F.when(shaped, F.regexp_replace(v, "[0-9]", "\u0000"))
    if kind == "numericId":
        return "survivingFormat", F.concat(F.octet_length(v).cast("string"), F.lit(":"), _zeros(v).cast("string"))
    if kind == "numericValue":
        body = F.regexp_replace(v, "^[+-]", "")
        whole, point = F.substring_index(body, ".", 1), F.contains(body, F.lit("."))
        part = F.concat(F.regexp_extract(v, "^([+-]?)", 1), F.octet_length(whole).cast("string"), F.lit(":"), _zeros(whole).cast("string"))
        return "survivingFormat", F.concat(part, F.when(point, F.concat(F.lit("."), F.octet_length(F.substring_index(body, ".", -1)).cast("string"))).otherwise(""))
    if kind in NAMES:
        return "survivingFormat", F.size(F.filter(F.split(v, r"(?U)\s+"), lambda t: t != "")).cast("string")
    if kind == "uuid":
        return "survivingFormat", F.when(~v.rlike("[A-Za-z]"), "digits").when(v == F.upper(v), "upper").otherwise("other")
    return "blankPattern", _blank(v)


def _blank(v: Column) -> Column:
    return F.when(V.is_empty(V.trimmed(v)), F.concat(F.lit("blank:"), v)).otherwise("")


def projected(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The projections, as columns of those names; null stays null."""
    return df.select(*[e.alias(c) for c, e in columns.items()])


def classes(rows: DataFrame) -> DataFrame:
    """(size, n): how many classes have each size. Null and "" are one value."""
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in rows.columns]
    return rows.select(*keys).groupBy(*rows.columns).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def summary(rows: DataFrame) -> DataFrame:
    """rows_measured, distinct_classes, unique_rows, smallest_class, fifth_percentile_class_size: one row."""
    sizes = classes(rows).withColumn("rows", F.col("size") * F.col("n"))
    # One row for each class size, of which there are few: their running sum is no large task.
    running = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("rows").over(Window.partitionBy())
    marked = sizes.withColumn("upto", F.sum("rows").over(running)).withColumn("total", total)
    need = F.greatest(F.lit(1), F.ceil(F.col("total") / 20))
    return marked.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_measured"), F.coalesce(F.sum("n"), F.lit(0)).alias("distinct_classes"), F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("n"))), F.lit(0)).alias("unique_rows"),
        F.coalesce(F.min("size"), F.lit(0)).alias("smallest_class"), F.coalesce(F.min(F.when(F.col("upto") >= need, F.col("size"))), F.lit(0)).alias("fifth_percentile_class_size"),
    )


def matched_columns(rows: DataFrame) -> DataFrame:
    """(col, matched, matched_every_row): a column counts if it takes more than one value; with one row, if it is not empty."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    facts = rows.agg(F.count("*").alias("rows"), *[x for c in rows.columns for x in (F.min(some(c)).alias(f"{c}|low"), F.max(some(c)).alias(f"{c}|high"), F.count(c).alias(f"{c}|full"))])
    item = lambda c: F.struct(
        F.lit(c).alias("col"), F.coalesce((F.col(f"`{c}|low`") != F.col(f"`{c}|high`")) | ((F.col("rows") == 1) & (F.col(f"`{c}|high`") != "")), F.lit(False)).alias("matched"), (F.col(f"`{c}|full`") == F.col("rows")).alias("matched_every_row")
    )
    return facts.select(F.explode(F.array(*[item(c) for c in rows.columns])).alias("x")).select("x.*")


def leave_one_out(rows: DataFrame) -> DataFrame:
    """(col, unique_rows_without): unique rows if the column were dropped, by one pass of grouping sets.

    Each set groups by all columns but one; Spark expands a row once for each column and adds up partial counts.
    """
    keys = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in rows.columns])
    n = len(rows.columns)
    sets = [[F.col(c) for c in rows.columns if c != out] for out in rows.columns]
    counted = keys.groupingSets(sets, *[F.col(c) for c in rows.columns]).agg(F.grouping_id().alias("g"), F.count("*").alias("size"))
    names = F.create_map(*[x for k, c in enumerate(rows.columns) for x in (F.lit(1 << (n - 1 - k)).cast("long"), F.lit(c))])
    return counted.groupBy(names[F.col("g")].alias("col")).agg(F.count_if(F.col("size") == 1).alias("unique_rows_without"))


def verdict(s: dict, matched: int, incomplete: bool = False) -> str:
    """review, info or verified for the figures of `summary`."""
    if incomplete:
        return "review"
    if not matched:
        return "info"
    return "review" if s["unique_rows"] > 0 or s["smallest_class"] < VERIFIED_FLOOR else "verified"
