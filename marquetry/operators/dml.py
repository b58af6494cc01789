"""Inserts, updates and deletes as transforms from the old table to the new one; a writer commits the result as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows of both; missing columns become null."""
    return table.unionByName(rows, allowMissingColumns=True)


def accepted(table: DataFrame, rows: DataFrame, unique: list[str]) -> DataFrame:
    """The new rows that clash with the table in none of the unique columns (nulls never clash)."""
    for c in unique:
        rows = rows.join(table.select(c).filter(F.col(c).isNotNull()).distinct(), c, "left_anti")
    return rows


def guarded_append(table: DataFrame, rows: DataFrame, unique: list[str]) -> DataFrame:
    return append(table, accepted(table, rows, unique).select(*rows.columns))


def update(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows that satisfy the condition take the new values; a null condition leaves the row."""
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is not true; a null condition keeps the row."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def delete_keys(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return table.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_anti").select(*table.columns)


def delete_owned(table: DataFrame, requests: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows that remain after requests (key, owner): a row goes only if one of its key comes from its own owner. Null keys and
    owners ask for nothing."""
    asked = requests.select(F.col(key), F.col(owner)).na.drop().distinct()
    return table.join(asked, [key, owner], "left_anti").select(*table.columns)


def prepend(table: DataFrame, rows: DataFrame, order: str, at: int) -> DataFrame:
    """New rows in front of the old ones: rows take the number `at` in the column `order`; the list is read by it in descending
    order, then by the rows' own key. Tables without the column count as 0."""
    old = table if order in table.columns else table.withColumn(order, F.lit(0))
    return append(old, rows.withColumn(order, F.lit(at)))


def cascade(children: DataFrame, foreign_key: str, deleted: DataFrame) -> DataFrame:
    """Children that remain after the parents named in `deleted` (one key column) went; children without parent stay."""
    return delete_keys(children, foreign_key, deleted)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Old rows of the same key go, the new rows come."""
    return append(table.join(rows.select(key).distinct(), key, "left_anti").select(*table.columns), rows)


def update_in_array(column: str, test, change) -> Column:
    """The array with `change` applied to the elements that pass `test`."""
    return F.transform(F.col(column), lambda x: F.when(test(x), change(x)).otherwise(x))
