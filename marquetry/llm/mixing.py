"""Mixing of sources to target weights, sized in tokens.

Two kinds of weights. Exact: every source with documents has its target share; the total is the largest one that breaks no
repetition limit, or, where a total is stated, the weights move from the targets towards the capacities (w_i ~ target_i**x *
capacity_i**(1-x)) no further than the limits ask. Tempered: w_i ~ (token share_i)**x; the exponent is bisected until the weights
have the entropy of the targets, and from there towards 1 until the stated total breaks no repetition limit.

Weights become documents by budgeted block permutations: a source is read whole as often as its budget holds it, and then in
blocks of documents in hashed order until the budget is used; the block on the border is split into blocks once more, and only
the small block on its border is cut: in hashed order it takes the documents that still fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions.text import trimmed
from marquetry.llm.tokenize import TOKENIZERS, VOCABULARY, token_counts
from marquetry.session import written

#: Documents in a small block on average, as long as a source has no more than BLOCKS * BLOCKS of them.
BLOCK_DOCUMENTS = 2_000
#: Blocks of a source, and small blocks of its border block, at most: so many sums are ordered in one task.
BLOCKS = 1_000
#: Targets may name at most so many sources: they are known to the driver and to every task.
MOST_SOURCES = 100_000
STEPS = 60


@dataclass
class Source:
    name: str
    target: float
    repeats: int
    tokens: int
    documents: int

    @property
    def capacity(self) -> int:
        return self.tokens * self.repeats


def bisected(holds: Callable[[float], bool], low: float, high: float, steps: int = STEPS) -> float:
    """The largest x in low..high for which `holds`, which is true below and false above some point; high if true there."""
    if holds(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], wanted_entropy: float) -> tuple[float, list[float]]:
    """Exponent x and weights ~ share**x whose entropy is as wanted, or as near as the number of sources allows (x in 0..64)."""

    def weights(x: float) -> list[float]:
        top = max(shares)
        w = [(s / top) ** x if s > 0 else 0.0 for s in shares]
        return [v / sum(w) for v in w]

    x = bisected(lambda v: entropy(weights(v)) >= wanted_entropy, 0.0, 64.0)
    return x, weights(x)


def target_weights(sources: list[Source], total: float | None = None) -> tuple[float, float, dict[str, float]]:
    """(exponent, total tokens, weight by source). Sources without capacity or target get 0, the others share all of the total.

    A total above the capacity of all targeted sources together is lowered to it.
    """
    live = [s for s in sources if s.capacity > 0 and s.target > 0]
    if not live:
        return 1.0, 0.0, {s.name: 0.0 for s in sources}
    all_targets, room = sum(s.target for s in live), float(sum(s.capacity for s in live))

    def weights(x: float) -> dict[str, float]:
        w = {s.name: (s.target / all_targets) ** x * (s.capacity / room) ** (1 - x) for s in live}
        z = sum(w.values())
        return {k: v / z for k, v in w.items()}

    if total is None:
        x, total = 1.0, min(s.capacity * all_targets / s.target for s in live)
    else:
        total = min(total, room)
        x = bisected(lambda v: all(total * weights(v)[s.name] <= s.capacity * (1 + 1e-12) for s in live), 0.0, 1.0)
    w = weights(x)
    return x, total, {s.name: w.get(s.name, 0.0) for s in sources}


def tempered_weights(sources: list[Source], total: float) -> tuple[float, float, dict[str, float]]:
    """(exponent, total tokens, weight by source) of tempered token shares at the stated total.

    The exponent gives the entropy of the targets (over the sources that have documents and a target), if that breaks no
    repetition limit at this total; else it is the nearest one on the way to 1 that doesn't. At 1 all sources are repeated alike, so
    a total above the least max_repeats times all tokens is lowered to that."""
    live = [s for s in sources if s.capacity > 0 and s.target > 0]
    if not live:
        return 1.0, 0.0, {s.name: 0.0 for s in sources}
    tokens, targets = float(sum(s.tokens for s in live)), sum(s.target for s in live)
    total = min(total, tokens * min(s.repeats for s in live))
    wanted, _ = tempered([s.tokens / tokens for s in live], entropy([s.target / targets for s in live]))

    def weights(x: float) -> list[float]:
        top = max(s.tokens for s in live)
        w = [(s.tokens / top) ** x for s in live]
        return [v / sum(w) for v in w]

    def holds(x: float) -> bool:
        return all(total * w <= s.capacity * (1 + 1e-12) for w, s in zip(weights(x), live))

    # from 1, where every limit holds, to the wanted exponent on either side of it
    x = 1 + bisected(lambda v: holds(1 + v * (wanted - 1)), 0.0, 1.0) * (wanted - 1)
    w = dict(zip((s.name for s in live), weights(x)))
    return x, total, {s.name: w.get(s.name, 0.0) for s in sources}


def source_key(c: Column) -> Column:
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def sized(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (normalised), tokens of documents with a source and a text that is not blank."""
    d = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").filter(F.col("source").isNotNull() & F.col("text").rlike(r"\S"))
    return token_counts(d, ["doc_id", "source"], "text", tokenizers, vocabulary).filter("tokens > 0")


def _fill(block: pd.DataFrame) -> pd.DataFrame:
    """One border block, in hashed order: each document that still fits is taken, larger ones are passed over."""
    block = block.sort_values(["place", "doc_id"])
    left, extra = float(block["left"].iloc[0]), []
    for n in block["tokens"]:
        extra.append(int(n <= left))
        left -= n * extra[-1]
    return block[["source", "doc_id", "tokens", "full"]].assign(extra=extra)


class Mix:
    """A mixture of documents (doc_id, text, source; doc_id unique) for targets (source, target_share, max_repeats).

    targets is a small table (one row per named source, at most MOST_SOURCES, collected; more raise); of several rows of one source the shares add and the
    least max_repeats holds; null or negative shares and repeats count as 0. Documents without source, of sources not
    named, or with null or blank text take no part. Empty tables give empty results. `tempered` takes tempered token shares for
    weights, at the stated total or, without one, at that of all tokens of the named sources.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, block: int = BLOCK_DOCUMENTS, tempered: bool = False) -> None:
        spark = documents.sparkSession
        zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
        named = targets.select(source_key(F.col("source")).alias("source"), zero("target_share").cast("double").alias("target"), zero("max_repeats").cast("bigint").alias("repeats"))
        named = named.filter("source is not null").groupBy("source").agg(F.sum("target").alias("target"), F.min("repeats").alias("repeats"))
        asked = named.limit(MOST_SOURCES + 1).collect()
        if len(asked) > MOST_SOURCES:
            raise ValueError(f"targets name more than {MOST_SOURCES} sources")
        names = spark.createDataFrame([(r.source,) for r in asked], "source string")
        docs = written(sized(documents).join(F.broadcast(names), "source", "left_semi").withColumn("place", F.xxhash64(F.lit(seed), "doc_id")))
        stats = {r.source: r for r in docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")).collect()}
        self.sources = [Source(r.source, r.target, r.repeats, *((stats[r.source].tokens, stats[r.source].documents) if r.source in stats else (0, 0))) for r in sorted(asked)]
        if tempered:
            every = sum(s.tokens for s in self.sources if s.target > 0 and s.repeats > 0)
            self.exponent, self.total, self.weights = tempered_weights(self.sources, every if total is None else total)
        else:
            self.exponent, self.total, self.weights = target_weights(self.sources, total)
        plan = []
        for s in self.sources:
            budget = self.total * self.weights[s.name]
            full = min(s.repeats, int(budget // s.tokens)) if s.tokens else 0
            blocks = max(1, min(BLOCKS, math.ceil(math.sqrt(s.documents / block))))
            plan.append((s.name, s.target, int(full), float(budget - full * s.tokens) if full < s.repeats else 0.0, blocks))
        self.plan = spark.createDataFrame(plan, "source string, target double, full bigint, rest double, blocks bigint")
        self.documents = docs

    def chosen(self) -> DataFrame:
        """doc_id, source, tokens, repeats (at least 1) of the documents in the mixture."""
        d = self.documents.join(F.broadcast(self.plan), "source").withColumn("block", F.pmod("place", F.col("blocks"))).withColumn("small", F.pmod(F.floor(F.col("place") / F.col("blocks")), F.col("blocks")))
        d = d.select("doc_id", "source", "tokens", "place", "full", "rest", "block", "small")

        def marks(rows: DataFrame, by: str, rest: str) -> DataFrame:
            """Of each block in hashed order: whole (it fits into the rest), border (it is the first that doesn't), left (what the ones before it left)."""
            sums = rows.groupBy("source", by, F.col(rest).alias("r")).agg(F.sum("tokens").alias("n"))
            run = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(7), by), by).rowsBetween(Window.unboundedPreceding, -1)
            sums = sums.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
            whole = (F.col("before") + F.col("n")) <= F.col("r")
            return sums.select("source", by, whole.alias(f"{by}_whole"), (~whole & (F.col("before") < F.col("r"))).alias(f"{by}_border"), (F.col("r") - F.col("before")).alias(f"{by}_left"))

        m = d.join(marks(d, "block", "rest"), ["source", "block"])
        edge = m.filter("block_border").drop("block_whole", "block_border")
        edge = edge.join(marks(edge, "small", "block_left"), ["source", "small"])
        border = edge.filter("small_border").select("source", "small", "doc_id", "tokens", "full", "place", F.col("small_left").alias("left"))
        border = border.groupBy("source", "small").applyInPandas(_fill, border.select("source", "doc_id", "tokens", "full").schema.simpleString()[7:-1].replace(":", " ") + ", extra bigint")
        parts = [m.filter("not block_border").withColumn("extra", F.col("block_whole").cast("bigint")), edge.filter("not small_border").withColumn("extra", F.col("small_whole").cast("bigint")), border]
        columns = ["doc_id", "source", "tokens", (F.col("full") + F.col("extra")).alias("repeats")]
        return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]).filter("repeats > 0")

    def shares(self) -> DataFrame:
        """One row per named source: target_share, weight (normalised over sources with documents), documents, tokens available
        and used, documents_used, most_repeats, actual_share."""
        spark = self.documents.sparkSession
        known = spark.createDataFrame([(s.name, s.target, self.weights[s.name], s.documents, s.tokens) for s in self.sources], "source string, target_share double, weight double, documents bigint, tokens bigint")
        used = self.chosen().groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_used"), F.count("*").alias("documents_used"), F.max("repeats").alias("most_repeats"))
        out = known.join(used, "source", "left").na.fill(0, ["tokens_used", "documents_used", "most_repeats"])
        all_used = F.sum("tokens_used").over(Window.partitionBy())
        return out.withColumn("actual_share", F.round(F.col("tokens_used") / F.greatest(all_used, F.lit(1)), 6))
