"""JSON text columns as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.schemas import JSON_RELATIONS


def parsed(column: Column, relation: str) -> Column:
    """JSON array text as a typed array; null, blank and malformed text give an empty array."""
    kind = JSON_RELATIONS[relation]
    return F.coalesce(F.from_json(column, kind, {"mode": "PERMISSIVE"}), F.from_json(F.lit("[]"), kind))


def exploded(df: DataFrame, column: str, relation: str) -> DataFrame:
    """One row per array element with its position; the element's fields carry the prefix `item_` against clashing names."""
    rows = df.select("*", F.posexplode(parsed(F.col(column), relation)).alias("item_pos", "item"))
    fields = [f.name for f in rows.schema["item"].dataType.fields]
    return rows.select("*", *[F.col("item").getField(f).alias(f"item_{f}") for f in fields]).drop("item")


def as_json(*columns: str) -> Column:
    """A row's columns as one JSON object, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
