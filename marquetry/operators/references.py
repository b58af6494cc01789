"""References between tables, and those that lead nowhere.

References and parent keys are co-partitioned by normalised key and sorted, and both streams are merged linearly: that is
Spark's sort-merge join, which never builds a hash table of either side. A key that many rows refer to is salted: its
references spread over several merge tasks, and its one parent row is repeated once per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.functions import text as X

# A key with more references than this is hot. At most rows/HOT keys can be hot; only their salts are repeated.
HOT_REFERENCES = 200_000
SALTS = 64
STATES = ("ok", "missing", "deleted", "late")


def normal_key(c: Column) -> Column:
    """Letter case and outer blanks do not count; null and blank keys become null (no reference)."""
    return F.nullif(F.lower(X.trimmed(c)), F.lit(""))


def parent_intervals(parents: DataFrame, removals: DataFrame, entity: str, key: str = "id", created: str = "created_at") -> DataFrame:
    """One row per key that exists or was removed: key, valid_from (null: no row), removed (no return).

    Repeated rows of a key count once with their earliest created_at; a row without created_at is valid from the start.
    """
    rows = parents.select(normal_key(F.col(key)).alias("k"), F.lit(True).alias("present"), F.coalesce(F.col(created).cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("valid_from"), F.lit(False).alias("removed"))
    gone = removals.filter(F.col("entity") == entity).select(normal_key(F.col("entity_id")).alias("k"), F.lit(False).alias("present"), F.lit(None).cast("timestamp").alias("valid_from"), F.col("restored_at").isNull().alias("removed"))
    return rows.unionByName(gone).filter("k is not null").groupBy("k").agg(F.max("present").alias("present"), F.min("valid_from").alias("valid_from"), F.max("removed").alias("removed"))


def reference_states(refs: DataFrame, parents: DataFrame, hot: int = HOT_REFERENCES, salts: int = SALTS) -> DataFrame:
    """Adds `state` to references.

    refs: table_name, record_id, ref (raw key), created_at. parents: parent_intervals.
    state: null for null and blank references; else missing (no row and never one in the log), deleted (removed and not
    restored, whether or not a row is left), late (the parent's row is younger than the reference), ok.
    A reference without created_at is never late. Deleted wins over missing and late.
    """
    r = refs.select("table_name", "record_id", "created_at", normal_key(F.col("ref")).alias("k"))
    blank = r.filter("k is null").select("table_name", "record_id", "created_at", "k", F.lit(None).cast("string").alias("state"))
    r = r.filter("k is not null")
    heavy = r.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("k", F.lit(True).alias("heavy"))
    # at most rows/hot keys: joined by broadcast where the optimiser finds them small, by merge elsewhere
    marked = r.join(heavy, "k", "left")
    left = marked.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("record_id"), F.lit(salts))).otherwise(F.lit(0)))
    right = parents.join(heavy, "k", "left").withColumn("salt", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("heavy")
    merged = left.join(right.withColumnRenamed("k", "pk").withColumnRenamed("salt", "psalt").hint("merge"), (F.col("k") == F.col("pk")) & (F.col("salt") == F.col("psalt")), "left")
    state = (
        F.when(F.coalesce("removed", F.lit(False)), "deleted")
        .when(~F.coalesce("present", F.lit(False)), "missing")
        .when(F.col("valid_from") > F.col("created_at").cast("timestamp"), "late")
        .otherwise("ok")
    )
    return merged.select("table_name", "record_id", "created_at", "k", state.alias("state")).unionByName(blank)


def orphans_by_period(states: DataFrame) -> DataFrame:
    """Per table and month of the referring row (null: no created_at): references, missing, deleted, late, orphans, orphan_percent."""
    one = lambda s: F.count_if(F.col("state") == s).alias(s)
    out = states.filter("state is not null").groupBy("table_name", F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM").alias("period")).agg(F.count("*").alias("refs"), one("missing"), one("deleted"), one("late"))
    out = out.withColumn("orphans", F.expr("missing + deleted + late"))
    return out.withColumn("orphan_percent", F.round(F.col("orphans") * 100.0 / F.col("refs"), 2))
