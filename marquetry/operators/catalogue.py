"""Users, sections and files: counts, shares, nested lists, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.functions import text as X


def with_child_count(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 for none. Children are counted before the join (map-side combine)."""
    n = children.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias(name))
    return parents.join(n, parents[parent_key] == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))


def nested_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, columns: list[str], name: str) -> DataFrame:
    """Parents with the sorted array of their children; an empty array for none."""
    item = F.struct(*columns)
    lists = children.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(F.sort_array(F.collect_list(item)).alias(name))
    return parents.join(lists, parents[parent_key] == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.array()))


def shares(df: DataFrame, by: Column, name: str) -> DataFrame:
    """Rows per value with percent of the total (one decimal): name, n, percent. No rows in, no rows out."""
    n = df.groupBy(by.alias(name)).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / n.agg(F.sum("n")).scalar(), 1))


def share_of_max(df: DataFrame, column: str, name: str = "share") -> DataFrame:
    """Each row's share of the largest value, the scale being at least 1. The maximum is a scalar subquery: no row moves for it."""
    return df.withColumn(name, F.round(F.col(column) * 100.0 / F.greatest(df.agg(F.max(column)).scalar(), F.lit(1)), 1))


def section_summary(df: DataFrame, section: str, member: str, value: str) -> DataFrame:
    """Per section: results, mean value rounded to an integer (null as 0), distinct members (all nulls are one member)."""
    return df.groupBy(X.falsy_to(F.col(section), "Unassigned").alias("section")).agg(
        F.count("*").alias("results"),
        F.floor(F.avg(F.coalesce(F.col(value).cast("decimal(18,6)"), F.lit(0))) + F.lit(0.5)).cast("bigint").alias("mean_value"),
        (F.count_distinct(F.col(member)) + F.max(F.col(member).isNull().cast("int"))).cast("bigint").alias("members"),
    )


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows where any column contains the query, letter case ignored, nulls as empty; the empty query keeps all rows."""
    test = X.contains_ci(F.col(columns[0]), query)
    for c in columns[1:]:
        test = test | X.contains_ci(F.col(c), query)
    return df.filter(test)


def filter_files(df: DataFrame, query: str = "", kind: str = "all", section: str = "all") -> DataFrame:
    """Search in the name, kind and section at once; 'all' switches a condition off."""
    out = search(df, query, ["name"])
    out = out if kind == "all" else out.filter(F.col("kind") == kind)
    return out if section == "all" else out.filter(F.col("section") == section)


def contacts(*parts: tuple[DataFrame, str, str]) -> DataFrame:
    """Union of (table, name column, role) as name, role; null and empty names are left out."""
    frames = [df.filter(F.length(F.col(c)) > 0).select(F.col(c).alias("name"), F.lit(role).alias("role")) for df, c, role in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def by_key(df: DataFrame, value, key: str = "id", **owner) -> DataFrame:
    """The row of a key, if its owner columns have the given values too; none otherwise. The conditions reach the scan."""
    test = F.col(key) == F.lit(value)
    for c, v in owner.items():
        test = test & (F.col(c) == F.lit(v))
    return df.filter(test).limit(1)


def taken_by_others(df: DataFrame, column: str, value, key: str, me) -> DataFrame:
    """Rows other than `me` that hold the value (the check before an update of a unique column)."""
    return df.filter((F.col(column) == F.lit(value)) & (F.col(key) != F.lit(me)))


def grouped_rows(df: DataFrame, by: str, columns: list[str], name: str = "rows", default: str = "Unassigned") -> DataFrame:
    """Rows of each group as a sorted array; null and empty groups together under the default."""
    return df.groupBy(X.falsy_to(F.col(by), default).alias(by)).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def totals(df: DataFrame, size: str, kind: str) -> DataFrame:
    """One row: files, total_size (null sizes count as 0; 0 for no file), kinds (different ones, null not counted)."""
    return df.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total_size"), F.count_distinct(F.col(kind)).alias("kinds"))


def total_children(nested: DataFrame, column: str) -> DataFrame:
    """One row: parents, and children, the sum of the sizes of the arrays in `column` (null arrays count as empty)."""
    return nested.agg(F.count("*").alias("parents"), F.coalesce(F.sum(F.greatest(F.size(column), F.lit(0))), F.lit(0)).cast("bigint").alias("children"))


def overall_mean(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row: the mean rounded half up to an integer, nulls counting as 0; 0 for no rows."""
    return df.agg(F.coalesce(F.floor(F.avg(F.coalesce(F.col(value).cast("decimal(18,6)"), F.lit(0))) + F.lit(0.5)), F.lit(0)).cast("bigint").alias(name))


def allowed(df: DataFrame, users: DataFrame, me: Column, roles: tuple[str, ...], key: str = "id", role: str = "role") -> DataFrame:
    """All rows of df if the user whose key is `me` has one of the roles, else none. One user row (limit 1) is all that is broadcast."""
    gate = users.filter((F.col(key) == me) & F.col(role).isin(*roles)).limit(1).select(F.lit(1).alias("_gate"))
    return df.withColumn("_open", F.lit(1)).join(F.broadcast(gate), F.col("_open") == F.col("_gate"), "left_semi").drop("_open")


def others(df: DataFrame, key: str, me: Column) -> DataFrame:
    """Rows of others than `me`: what may be deleted by its own user's request is never the user. Null keys are nobody and leave."""
    return df.filter(F.col(key) != me)


def first_by(df: DataFrame, key: str, n: int = 500) -> DataFrame:
    """The first n rows in order of a unique key (a report size)."""
    return df.orderBy(key).limit(n)


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where none of the columns is null."""
    return df.na.drop(subset=list(columns))
