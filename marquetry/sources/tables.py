"""Parquet tables and the record view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lazily read table; only the columns a query selects reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """Repeated deliveries of a row become one row.

    Rows that share the key are one record: the least of them, column by column, stays, whatever the order of delivery. Null
    keys share one row as well. Use it on narrow projections: the shuffle carries every column of df.
    """
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) if c != key else F.col(c) for c in df.columns])


#: A table of fewer bytes per task than this may lie in fewer row groups than there are tasks.
SMALL_BYTES = 16 << 20


def spread(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of a table of `size` bytes over all tasks by key, if it is so small that few tasks would read it; a large one stays as it
    is read. The rows are the same either way."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, key) if size < tasks * SMALL_BYTES else df


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table as read, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
