"""Activity feed: pages, filters, rolling counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions import labels as L


def page(df: DataFrame, order: list[Column], limit: int = 10, offset: int = 0) -> DataFrame:
    """One page of the whole table, newest first; `order` must end in a unique column. Beyond the end: no rows."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_per_key(df: DataFrame, key: str, order: list[Column], limit: int = 10, offset: int = 0) -> DataFrame:
    """The same page for every key at once, with the key's total.

    row_number <= n is pushed into a per-partition group limit before the shuffle, so a hot key ships few rows.
    """
    w = Window.partitionBy(key).orderBy(*order)
    top = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= offset + limit)
    totals = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("total"))
    return top.filter(F.col("rn") > offset).join(totals, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def by_type(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows of one type, all rows for 'all'."""
    return df if wanted == "all" else df.filter(F.col(column) == wanted)


def rolling_counts(df: DataFrame, ts: str, now: Column) -> DataFrame:
    """One row: total, this_week (younger than 7 days), today (younger than 24 hours). Future rows count, null times only in total."""
    t = F.col(ts)
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(t > now - F.expr("INTERVAL 7 DAYS")).alias("this_week"),
        F.count_if(t > now - F.expr("INTERVAL 24 HOURS")).alias("today"),
    )


# Texts of feed entries.
DESCRIPTIONS = {"code": "Analyzed %s code - %s%% clone detected", "mock": "Analyzed %s code - %s%% clone detected (mock)", "file": "Analyzed %s file: %s - %s%% clone detected", "batch": "Uploaded batch: %s - %s files extracted%s"}


def described(kind: str, *values: Column) -> Column:
    """The text of a feed entry of a kind; null where a value is null. A batch ends with its section (see in_section)."""
    known = reduce(Column.__and__, [v.isNotNull() for v in values])
    return F.when(known, F.format_string(DESCRIPTIONS[kind], *values))


def in_section(section: Column) -> Column:
    """' (Section: name)', empty for null and empty names."""
    return F.when(F.length(section) > 0, F.concat(F.lit(" (Section: "), section, F.lit(")"))).otherwise(F.lit(""))


def with_labels(df: DataFrame, ts: str, now: Column, status: str | None = None) -> DataFrame:
    """Adds age_label, and shown_status ('success' for null and empty)."""
    out = df.withColumn("age_label", L.age_label(F.col(ts), now))
    return out.withColumn("shown_status", F.coalesce(F.nullif(F.col(status), F.lit("")), F.lit("success"))) if status else out
