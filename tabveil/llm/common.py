"""Places and small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session; set here only if it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='tabveil-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of texts of `rows` rows, unless the session has a number of its own: the default of 10,000 is some 50 MB a batch on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """A selection under fixed names, so that extra or clashing columns of df do no harm: only(df, text="body").

    What has the name already stays a plain column: exchanges of it are then equal and can be shared.
    """
    return df.select(*[F.col(f"`{v}`") if k == v else F.col(f"`{v}`").alias(k) for k, v in columns.items()])


def aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns that have one of the names under others, and how to name them back."""
    back = {f"{n}__own": n for n in names if n in df.columns}
    return df.withColumnsRenamed({v: k for k, v in back.items()}), back


def whole_number(df: DataFrame, column: str) -> DataFrame:
    """df with the column as BIGINT."""
    return df if dict(df.dtypes)[column] == "bigint" else df.withColumn(column, F.col(column).cast("long"))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers of which hash partitioning sends one to each of n partitions, so that buckets under these keys never share one."""
    rows = spark.range(0, 20 * n + 50, 1, 1).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()
    found = {r["p"]: r["k"] for r in rows}
    return [found.get(p, p) for p in range(n)]
