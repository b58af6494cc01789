"""Connected components over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.session import cut


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (the least node it is connected with). nodes: node; edges: a, b. Labels spread along the edges and jump
    to their label's label; every round is cut to the shared folder. Stops when nothing changes; raises if `rounds` don't do."""
    e = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("component")).distinct())
    if e.isEmpty():
        return labels
    for _ in range(rounds):
        near = e.join(labels, e["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("n"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", "n").alias("m"))
        up = step.select(F.col("node").alias("x"), F.col("m").alias("up"))
        new = cut(step.join(up, F.col("m") == F.col("x"), "left").select("node", "old", F.least("m", F.coalesce("up", "m")).alias("component")))
        if new.filter("old <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
    raise RuntimeError("components did not settle")
