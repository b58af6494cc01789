"""Exact line clones inside a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions import text as X
from marquetry.operators.metrics import SHORTEST_CLONE


def clone_pairs(df: DataFrame, key: str, text: str, first: int | None = 5) -> DataFrame:
    """Each repeat of a trimmed line (longer than 10 characters) with the line's first occurrence.

    Columns: key, pair_no, first_line, repeat_line; lines count from 1 among the non-blank lines. `first` keeps the
    first pairs of a document in order of the repeat (a report size; None keeps all). Duplicates of `key` must be removed
    before. The frames run inside one document, so a window task never holds more than one document's lines, and both windows
    live on the one exchange by document.
    """
    every = df.select(F.col(key), F.transform(X.solid_lines(F.col(text)), X.trimmed).alias("_l"))
    kept = F.filter("_l", lambda x: F.length(x) > SHORTEST_CLONE)
    # documents without a repeat end here, inside the scan's stage; the others' long lines travel once, by document
    able = every.filter(F.size(kept) > F.size(F.array_distinct(kept)))
    lines = able.select(key, F.posexplode("_l").alias("pos", "t")).filter(F.length("t") > SHORTEST_CLONE).select(key, (F.col("pos") + 1).alias("repeat_line"), "t").repartition(key)
    seen = lines.withColumn("first_line", F.min("repeat_line").over(Window.partitionBy(key, "t"))).filter("repeat_line > first_line")
    ranked = seen.withColumn("pair_no", F.row_number().over(Window.partitionBy(key).orderBy("repeat_line")))
    ranked = ranked if first is None else ranked.filter(F.col("pair_no") <= first)
    return ranked.select(key, F.col("pair_no").cast("bigint").alias("pair_no"), F.col("first_line").cast("bigint").alias("first_line"), F.col("repeat_line").cast("bigint").alias("repeat_line"))


def clone_structs(df: DataFrame, key: str, text: str, first: int | None = 5) -> DataFrame:
    """clone_pairs nested per document: key, clones array<struct<clone_type,similarity,locations>> (type 1, similarity 100)."""
    place = lambda c: F.struct(F.col(c).cast("int").alias("start_line"), F.col(c).cast("int").alias("end_line"))
    one = F.struct(F.col("pair_no"), F.lit(1).alias("clone_type"), F.lit(100.0).alias("similarity"), F.array(place("first_line"), place("repeat_line")).alias("locations"))
    return clone_pairs(df, key, text, first).groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("clones"))
