"""Comparisons beyond exact line clones and single runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions import text as X
from marquetry.operators.metrics import RESERVED, SHORTEST_CLONE

_RESERVED = "|".join(sorted(set(RESERVED["python"]) | set(RESERVED["java"])))


def normalised_line(line: Column) -> Column:
    """A line with names as N, numbers as 0 and strings as S: renamed copies become equal. Reserved words stay."""
    t = F.regexp_replace(line, r"\"[^\"]*\"|'[^']*'", "§")
    t = F.regexp_replace(t, rf"\b({_RESERVED})\b", "¤$1")
    t = F.regexp_replace(t, r"(^|[^\w¤])[A-Za-z_]\w*", "$1N")
    t = F.regexp_replace(t, r"(^|\W)\d[\w.]*", "$10")
    return F.replace(F.replace(F.regexp_replace(t, r"\s+", ""), F.lit("¤"), F.lit("")), F.lit("§"), F.lit("S"))


def renamed_clones(df: DataFrame, key: str, text: str, shortest: int = SHORTEST_CLONE) -> DataFrame:
    """Per document the lines that repeat an earlier line up to renaming (trimmed length above `shortest`): key, clone_lines, exact_lines.

    clone_lines counts repeats of normalised lines, exact_lines those that repeat the line as it is. Null text counts as empty.
    """
    lines = F.filter(F.transform(X.solid_lines(F.col(text)), X.trimmed), lambda x: F.length(x) > shortest)
    n = df.select(key, lines.alias("l")).select(key, F.size("l").alias("n"), F.size(F.array_distinct("l")).alias("d"), F.size(F.array_distinct(F.transform("l", normalised_line))).alias("m"))
    return n.select(key, (F.col("n") - F.col("m")).cast("bigint").alias("clone_lines"), (F.col("n") - F.col("d")).cast("bigint").alias("exact_lines"))


def changes(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Each row with the value before it in its group and the difference (null for the first, and where either is null)."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("change", F.round(F.col(value) - F.col("previous"), 4))


def ranked_by_impact(suggestions: DataFrame, impact: str, top: int) -> DataFrame:
    """The suggestions with the highest impact of each kind (a report of `top` ranks; equal impact shares a rank)."""
    w = Window.partitionBy("refactoring_type").orderBy(F.col(impact).desc())
    return suggestions.withColumn("impact_rank", F.rank().over(w)).filter(F.col("impact_rank") <= top)
