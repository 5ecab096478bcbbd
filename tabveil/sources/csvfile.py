"""CSV in and out with the cells as they are: all strings, short rows padded, surplus cells refused, formulas made harmless."""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.functions import values as V

CORRUPT = "_surplus"


def sniff(head: bytes) -> str:
    """utf-8, utf-16 or binary, from the first 8 KiB: byte order marks, then NUL bytes and where they stand."""
    head = head[:8192]
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    nul = head.count(0)
    if nul and 5 * nul >= len(head):
        even = head[::2].count(0)
        if 10 * max(even, nul - even) >= 9 * nul:
            return "utf-16"
    return "binary" if nul >= 2 and 100 * nul > len(head) else "utf-8"


def validated(spark: SparkSession, path: str) -> None:
    """Raises unless path is a file of a readable encoding; read by Spark, so that any store will do."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 8192).alias("head")).first()
    if head is None:
        raise FileNotFoundError(path)
    if (kind := sniff(bytes(head["head"]))) != "utf-8":
        raise ValueError(f"{path}: {kind} is not supported; save it as UTF-8")


def headers(spark: SparkSession, path: str) -> list[str]:
    row = spark.read.csv(path, header=False, multiLine=True, escape='"', mode="PERMISSIVE").limit(1).first()
    return [] if row is None else [(x or "").removeprefix("﻿") for x in row]


def scan(spark: SparkSession, path: str, index: str = "row_idx") -> DataFrame:
    """Columns _c0, _c1, ... and the row's place in file order. A row with a surplus cell that is not blank, at whatever place, fails the job."""
    names = headers(spark, path)
    columns = [f"_c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in [*columns, CORRUPT])
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    # Records with fewer or more cells come whole in the corrupt column; only those are taken apart again. Quoted cells cannot be blank but for white space.
    blank = rf"(?s)^(?:(?:[^,\"]|\"(?:[^\"]|\"\")*+\")*+,){{{max(len(names) - 1, 0)}}}+(?:[^,\"]|\"(?:[^\"]|\"\")*+\")*+(?:,(?U:\s)*+|,\"(?U:\s)*+\")*+$"
    more = rf"(?s)^(?:(?:[^,\"]|\"(?:[^\"]|\"\")*+\")*+,){{{len(names)}}}+"
    # The reader refuses plans that need the corrupt column alone, as a count would; the last test, always true, needs another one.
    surplus = F.coalesce(F.col(CORRUPT).rlike(more) & ~F.col(CORRUPT).rlike(blank), F.lit(False)) & (F.coalesce(F.length(columns[0]), F.lit(0)) >= 0)
    cells = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]
    safe = F.when(surplus, F.raise_error(F.lit("a row has more cells than the header, and they are not blank"))).otherwise(F.monotonically_increasing_id())
    return rows.select(safe.cast("long").alias(index), *cells)


def is_blank_row(columns: list[str]) -> Column:
    return F.forall(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns]), lambda x: x.rlike(r"(?U)^\s*$"))


def data_rows(df: DataFrame, columns: list[str]) -> int:
    return df.where(~is_blank_row(columns)).count()


def padded(rows: list[list[str]], width: int) -> list[list[str]]:
    """Rows of one width: short ones padded, blank surplus cut, other surplus refused."""
    out = []
    for r in rows:
        if any(x.strip() for x in r[width:]):
            raise ValueError("a row has more cells than the header, and they are not blank")
        out.append([*r[:width], *[""] * (width - len(r))])
    return out


def from_text(spark: SparkSession, text: str, index: str = "row_idx") -> tuple[DataFrame, list[str]]:
    """What scan and headers give, of a CSV that is at hand as a string, such as a pasted one."""
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")) if r]
    names = rows[0] if rows else []
    columns = [f"_c{i}" for i in range(len(names))]
    schema = ", ".join([f"{index} long", *[f"{c} string" for c in columns]])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(padded(rows[1:], len(names)))], schema), names


def to_text(df: DataFrame, names: list[str], order: str = "row_idx") -> str:
    """The CSV that sink would write, as a string; for tables as small as a pasted one."""
    columns = [c for c in df.columns if c != order]
    head = df.sparkSession.createDataFrame([tuple(names)], ", ".join(f"{c} string" for c in columns)) if columns else df.limit(0)
    safe = lambda rows: rows.select(*[V.neutralized(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in columns])
    out = io.StringIO(newline="")
    write = csv.writer(out, lineterminator="\n")
    write.writerows([*map(tuple, safe(head).collect()), *map(tuple, safe(df.orderBy(order)).collect())])
    return out.getvalue()


def anchors(found: DataFrame, rows: DataFrame, index: str = "row_idx") -> DataFrame:
    """The first row with a span of high confidence for each column. found: (col, row_idx, confidence)."""
    first = found.where(F.col("confidence") == "high").groupBy("col").agg(F.min(index).alias(index))
    return rows.join(first.select(index).distinct(), index)


def sink(df: DataFrame, names: list[str], path: str, force: bool = False, single: bool = False) -> None:
    """Minimal quoting, formulas neutralised in cells and headers; written by Spark's commit protocol, so a failure leaves nothing."""
    label = lambda n: df.sparkSession.range(1).select(V.neutralized(F.lit(n)).alias("n")).first()["n"] if n[:1] in "=+-@\t\r\n＝＋－＠ " else n
    out = df.select(*[V.neutralized(F.col(f"`{c}`")).alias(label(n)) for c, n in zip(df.columns, names, strict=True)])
    (out.coalesce(1) if single else out).write.csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="overwrite" if force else "errorifexists")


def output_path(path: str) -> str:
    stem, ext = os.path.splitext(path)
    return f"{stem}_private_output{ext}"


def destination(source: str, target: str, force: bool = False) -> str:
    if os.path.realpath(source) == os.path.realpath(target):
        raise ValueError("the output would replace the input")
    if os.path.exists(target) and not force:
        raise FileExistsError(target)
    return target
