"""Comparison of the members of a group by their mean results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions import labels as L


def member_means(df: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """One row per group and member: mean of the value (null counts as 0, and stays in the denominator), results.

    Null or empty groups are 'Unassigned'; null members are one member '(none)'.
    """
    return df.groupBy(
        F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("Unassigned")).alias("grp"), F.coalesce(F.col(member), F.lit("(none)")).alias("member")
    ).agg(F.round(F.avg(F.coalesce(F.col(value).cast("decimal(18,6)"), F.lit(0))), 4).cast("double").alias("mean_value"), F.count("*").alias("results"))


def score(a, b):
    """Mean of two means, rounded half up, kept in 5..95."""
    return L.clamped(L.rounded((a + b) / 2), 5, 95).cast("bigint")


def high_pairs(means: DataFrame, above: int = 70) -> DataFrame:
    """Unordered pairs of different members of a group whose score is above the bound, with pair key and status.

    The score is the rounded half of the sum, so a pair needs a sum of 2 * above + 1. Members that cannot reach it with the highest
    mean of their group never enter the join. The others are joined by group and whole points of the mean: each asks for the points
    at which a partner can be high enough, so the work of a large group spreads over as many keys as its means have points, and
    only pairs at the bound are dropped behind the join.
    """
    least = 2 * above + 1
    top = means.groupBy(F.col("grp").alias("g")).agg(F.max("mean_value").alias("top"))
    able = means.join(top, F.col("grp") == F.col("g")).filter(F.col("mean_value") + F.col("top") >= least)
    points = F.floor("mean_value").cast("int")
    from_, to = F.floor(F.lit(least) - F.col("mean_value")).cast("int"), F.floor("top").cast("int")
    a = able.select(F.col("grp").alias("g_a"), F.col("member").alias("member_a"), F.col("mean_value").alias("v_a"), F.explode(F.sequence(F.least(from_, to), to)).alias("at"))
    b = able.select("grp", F.col("member").alias("member_b"), F.col("mean_value").alias("v_b"), points.alias("points"))
    return (
        a.join(b, (F.col("g_a") == F.col("grp")) & (F.col("at") == F.col("points")) & (F.col("member_a") < F.col("member_b")) & (F.col("v_a") + F.col("v_b") >= least))
        .select("grp", "member_a", "member_b", score(F.col("v_a"), F.col("v_b")).alias("similarity"))
        .filter(F.col("similarity") > above)
        .withColumn("status", L.klass(F.col("similarity"), "similarity"))
    )


def pair_status_counts(means: DataFrame) -> DataFrame:
    """How many unordered pairs of a group fall into each status, without forming them.

    Means are counted in steps of their last decimal, so sums are exact and a group has at most 1,000,001 distinct ones however
    many members it has. A pair reaches a status from a sum of means on: one window in order of the means gives each mean the
    number of members that are high enough for it. Columns: grp, status, pairs.
    """
    bounds, lowest = L.ABOVE["similarity"]
    step = 10_000
    # the score is the rounded half of the sum, so above a bound means a sum of 2 * bound + 1 or more
    least = [(2 * bound + 1) * step for _, bound in bounds]
    n = means.groupBy("grp", F.round(F.col("mean_value") * step).cast("bigint").alias("v")).agg(F.count("*").alias("n"))
    # per mean: one row that adds its members (of = -1) and, for each bound, one that asks at the least mean of a partner
    adds = F.struct(F.col("v").alias("at"), F.lit(-1).alias("of"), F.lit(0).alias("own"))
    asks = [F.struct((F.lit(t) - F.col("v")).alias("at"), F.lit(i).alias("of"), (2 * F.col("v") >= t).cast("int").alias("own")) for i, t in enumerate(least)]
    rows = n.select("grp", "n", F.explode(F.array(adds, *asks)).alias("r")).select("grp", "n", "r.*")
    w = Window.partitionBy("grp").orderBy(F.col("at").desc(), "of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("partners", F.sum(F.when(F.col("of") < 0, F.col("n")).otherwise(0)).over(w))
    reach = [F.expr(f"sum(case when of = {i} then n * (partners - own) else 0 end) div 2") for i in range(len(least))]
    every = F.expr("sum(case when of < 0 then n else 0 end)")
    totals = rows.groupBy("grp").agg(every.alias("members"), *[r.alias(f"r{i}") for i, r in enumerate(reach)])
    up_to = [F.col(f"r{i}") for i in range(len(least))] + [F.expr("members * (members - 1) div 2")]
    counts = [F.struct(F.lit(name).alias("status"), (c - before).alias("pairs")) for name, c, before in zip([*(b for b, _ in bounds), lowest], up_to, [F.lit(0), *up_to])]
    return totals.select("grp", F.explode(F.array(*counts)).alias("r")).select("grp", "r.status", "r.pairs").filter("pairs > 0")


def pair_key(a, b):
    """Order-free key of two strings."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def first_pairs(df: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Distinct unordered pairs; of repeats the row that comes first by `order` stays (as min_by, which combines map-side)."""
    rest = [c for c in df.columns]
    row = F.min_by(F.struct(*rest), F.col(order)).alias("r")
    return df.groupBy(pair_key(F.col(a), F.col(b)).alias("pair_key")).agg(row).select("pair_key", *[F.col(f"r.{c}").alias(c) for c in rest])
