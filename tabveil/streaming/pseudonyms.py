"""Pseudonyms over a stream: a value keeps its output in all micro-batches, as the mapping is a table and not memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabveil.functions import values as V
from tabveil.operators import ranking


def extended(known: DataFrame, keys: DataFrame, seed: str) -> DataFrame:
    """Rows (key, n) for keys that the mapping lacks: places by hash behind its largest n."""
    start = known.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    new = keys.select("key").distinct().join(known, "key", "left_anti").withColumn("h", V.keyed_hash(F.lit(seed), F.lit("stream"), F.col("key")))
    return ranking.by_hash(new, F.col("h")).select("key", (F.col("rank") + start).alias("n"))


def run(source: DataFrame, column: str, mapping: str, out: str, checkpoint: str, seed: str, prefix: str = "user") -> StreamingQuery:
    """Writes source with `column` replaced to `out`, and new keys to `mapping`, each under its batch number.

    A batch that runs again overwrites its own folders, and reads the mapping without them: the outcome is the same.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        parts = spark.read.schema("key string, n long, batch long").option("recursiveFileLookup", "false").parquet(mapping) if number else spark.createDataFrame([], "key string, n long, batch long")
        known = parts.where(F.col("batch") < number).select("key", "n")
        keys = df.select(V.identity_key(F.col(column).cast("string")).alias("key")).where("key <> ''")
        extended(known, keys, seed).write.mode("overwrite").parquet(f"{mapping}/batch={number}")
        now = spark.read.schema("key string, n long, batch long").parquet(mapping).select(F.col("key").alias("_key"), F.col("n").alias("_n"))
        rows = df.withColumn("_k", V.identity_key(F.col(column).cast("string")))
        named = rows.join(now, F.col("_k") == F.col("_key"), "left").withColumn(column, F.concat(F.lit(prefix), F.col("_n").cast("string"))).select(*df.columns)
        named.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(source: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Counts and distinct users of a stream in tumbling windows, with late rows until the watermark."""
    return source.withWatermark(time, late).groupBy(F.window(time, length)).agg(F.count("*").alias("n"))
