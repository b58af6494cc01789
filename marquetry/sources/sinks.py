"""Sinks. A write is one job; a table that is replaced keeps its old state until the new one is complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """The new state of a table in place of the old one. rows may be read from `path` itself.

    The new state is written beside the old one and takes its place by renaming only when the job has ended; if the job fails,
    the old state stays as it was, and if the process dies between the two renames, it is found under `path`.old."""
    jvm, spark = rows.sparkSession._jvm, rows.sparkSession
    place, new, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + x) for x in ("", f".new-{uuid.uuid4().hex}", ".old"))
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        rows.write.parquet(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    if fs.exists(place):
        fs.delete(old, True)
        if not fs.rename(place, old):
            raise OSError(f"cannot rename {path}")
    if not fs.rename(new, place):
        raise OSError(f"cannot rename {new.toString()}")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def text_parts(rows: DataFrame, column: str, path: str, by: str | None = None) -> None:
    """The whole text of a column (not a preview), one line end after each row; a folder per value of `by`."""
    out = rows.select(F.coalesce(column, F.lit("")).alias("value"), *([by] if by else []))
    w = out.write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)
