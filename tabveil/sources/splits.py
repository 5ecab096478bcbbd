"""Small files over all cores: a Parquet row group is one task, however many cores wait."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes on disk for each core below which a table is dealt out; row groups are larger by far.
PER_CORE = 16 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df, for work that costs more than its rows' way over the network: in a part for each core where its files are too small to give each one its own.

    The size is what the optimizer knows of the files, so that nothing is read. Larger tables stay as they are scanned,
    without an exchange. Columns and filters chosen later still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < cores * PER_CORE else df
