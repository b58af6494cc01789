"""New batches against all accepted history: exact copies (by canonical keys) and near-duplicates (by word triples).

History is a folder of Parquet tables that are only appended to:
  keys      canonical key of every accepted text, once
  sets      once per different set of triples: g, size, triples, and `counts`, its row of the pivot-distance table
  postings  (triple, g, size) of the triples under which a set can be found
  order     the most frequent triples (at most ORDER) of the first ORDER_SETS sets and the rest of their batch, which fixes the
            order of triples for good; the sets accepted before that have all of their triples in the postings

A batch is encoded once and met with history three times, each time by less: its few first triples in the fixed order with the
postings (two sets similar enough share one of them, whatever the order); the pairs found with the pivot-distance table; what is
left with the sets themselves. The batch side is what travels: it is broadcast where its size, known beforehand, allows, so history
is scanned where it lies. History is never encoded, shuffled, compared or written again.

The metric is the number of triples in which two sets differ. It is the sum, over CLASSES classes of triples by hash, of the same
number within the class. The pivot is the empty set: its distance to a set within a class is the count of the set's triples there,
and by the triangle inequality two sets differ within a class by no less than their counts do. Distances to single sets of the
corpus as pivots prune next to nothing, see the README.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.llm.copies import field_key
from marquetry.llm.kernels import U, Words, text_chunks
from marquetry.llm.near_duplicates import THRESHOLD, set_digest, verified
from marquetry.llm.records import TEXT_KIND
from marquetry.session import ensure_checkpoint_dir, release, written

#: Classes of the pivot-distance table.
CLASSES = 128
#: Sets that are accepted before the order is fixed, and triples that it knows; all others come before these, in order of hash.
#: Any order is exact; frequent triples at its end make few candidates.
ORDER_SETS, ORDER = 1_000, 200_000
#: Sets of a batch whose rows of the pivot-distance table (about 270 bytes each) may be broadcast.
BROADCAST_SETS = 20_000
#: Rows of a batch's side of a join that may be broadcast (at most 40 bytes each); beyond it the join is a merge join.
BROADCAST_ROWS = 1_000_000

_ENCODED = "id string, word_key binary, field_key binary, g bigint, size int, triples binary, counts binary"
_SETS = "g bigint, size int, triples binary, counts binary"
_POSTINGS = "h bigint, old bigint, n int"


def _encode(classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _ENCODED.split(", ")]
        types = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for b in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in b.columns)) if r[0] is not None and r[2] is not None and r[2].strip()]
            out: list[tuple] = []
            rest = [pa.array([r[j] for r in rows], b.schema.types[j]) for j in range(3, b.num_columns)]
            texts = [r[2] for r in rows]
            for a, z in text_chunks(texts):
                w = Words(texts[a:z])
                doc, h = w.triples()
                size = np.bincount(doc, minlength=z - a)
                g = set_digest(doc, h, z - a).view(np.int64)
                of = doc * classes + (h >> U(40)).astype(np.int64) % classes
                counts = np.minimum(np.bincount(of, minlength=(z - a) * classes), 0xFFFF).astype(np.uint16).reshape(z - a, classes)
                ends = np.cumsum(size)
                for k, digest in enumerate(w.sequence_digests()):
                    i, kind, text = rows[a + k][:3]
                    key = (i, b"s" + digest, field_key(text) if kind == TEXT_KIND else None)
                    known = kind != TEXT_KIND and size[k] > 0
                    out.append((*key, int(g[k]), int(size[k]), h[ends[k] - size[k] : ends[k]].tobytes(), counts[k].tobytes()) if known else (*key, None, 0, None, None))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for t, c in zip(types, zip(*out) if out else [[]] * 7)), *rest], names=[*names, *b.schema.names[3:]])

    return run


def encoded(df: DataFrame, *keep: str) -> DataFrame:
    """_ENCODED (and the string columns `keep`) of texts (id, kind, text): canonical keys of all; g, size, triples and counts
    of those with at least three words, texts of declared type text left out. Null ids and blank texts are left out; repeated
    rows of an id are still there."""
    texts = df.select("id", F.coalesce("kind", F.lit("")).alias("kind"), "text", *keep)
    return texts.mapInArrow(_encode(CLASSES), ", ".join([_ENCODED, *(f"{c} string" for c in keep)]))


def _first_triples(threshold: float, order: np.ndarray, counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sets (g, size, triples) the triples that come first in the fixed order, one more than may differ: rows (h, g, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, gs, ns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for g, n, t in zip(*(c.to_pylist() for c in b.columns)):
                h = np.frombuffer(t, np.int64)
                at = np.minimum(np.searchsorted(order, h), max(0, len(order) - 1))
                cost = np.where(order[at] == h, counts[at], 0) if len(order) else np.zeros(len(h))
                first = h[np.lexsort((h, cost))[: n - int(np.ceil(threshold * n - 1e-9)) + 1]]
                hs.append(first), gs.append(np.full(len(first), g)), ns.append(np.full(len(first), n, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, gs, ns)], names=["h", "g", "size"])

    return run


def _pruned(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (g, old, size, n, p, q) whose rows p and q of the pivot-distance table do not exclude them by the triangle inequality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1).astype(np.int32) for c in ("p", "q"))
            size, n = b.column("size").to_numpy().astype(np.int64), b.column("n").to_numpy().astype(np.int64)
            # similar enough means that at most this many triples differ
            most = np.floor((1 - threshold) / (1 + threshold) * (size + n) + 1e-9)
            yield b.select(["g", "old"]).filter(pa.array(np.abs(p - q).sum(1) <= most))

    return run


def hits(rows: DataFrame, keys: DataFrame, sets: DataFrame, *of: str) -> DataFrame:
    """id, same, near of encoded rows with one of the keys (key), or a set that is one of the sets (g), that history holds. Of
    several batches, the columns `of` name a row's and its key's and set's batch."""
    same = each_key(rows, *of).join(keys, [*of, "key"], "left_semi").select("id", F.lit(True).alias("same"), F.lit(False).alias("near"))
    near = rows.filter("g is not null").select("id", *of, "g").join(sets, [*of, "g"], "left_semi").select("id", F.lit(False).alias("same"), F.lit(True).alias("near"))
    return same.unionByName(near).groupBy("id").agg(F.max("same").alias("same"), F.max("near").alias("near"))


@dataclass
class Batch:
    """An encoded batch: its rows (id, word_key, field_key, g), its different keys and sets, and the numbers of keys, sets and
    triples in all sets. Met with history: the keys that history holds, and pairs (g, old) of near sets; None where history has none.
    Where keys is None, they are met and appended by whoever made the batch."""

    rows: DataFrame
    keys: DataFrame | None
    sets: DataFrame
    n_keys: int
    n_sets: int
    triples: int
    known_keys: DataFrame | None = None
    pairs: DataFrame | None = None
    met: bool = False

    @classmethod
    def of(cls, texts: DataFrame) -> Batch:
        rows = written(encoded(texts))
        (keys, n_keys), (sets, n_sets, triples) = together(lambda: counted(each_key(rows).select("key").distinct()), lambda: counted(each_set(rows), F.coalesce(F.sum("size"), F.lit(0))))
        return cls(rows, keys, sets, n_keys, n_sets, triples)


def each_key(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select("id", *keep, F.explode(F.array_compact(F.array("word_key", "field_key"))).alias("key"))


def each_set(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.filter("g is not null").select(*keep, "g", "size", "triples", "counts").dropDuplicates([*keep, "g"])


class History:
    """Accepted batches under `path` (a folder that all executors share).

    Batches are tables of texts (id, kind, text), or a Batch. Null ids, null and blank texts match nothing;
    repeated rows of an id give one row; texts of a batch do not match each other. An empty batch or history gives no rows.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = THRESHOLD) -> None:
        self.spark, self.path, self.threshold = spark, path, threshold
        self._order: tuple[np.ndarray, np.ndarray] | None = None
        self._last: tuple[DataFrame, Batch] | None = None

    def _read(self, table: str, schema: str) -> DataFrame | None:
        at = os.path.join(self.path, table)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(at) if there else None

    def _append(self, df: DataFrame, table: str, rows: int, rows_a_file: int) -> None:
        df = df.coalesce(max(1, rows // rows_a_file))
        df.write.mode("append").option("parquet.enable.dictionary", "false").parquet(os.path.join(self.path, table))

    def _fixed_order(self) -> tuple[np.ndarray, np.ndarray]:
        if self._order is None:
            table = self._read("order", "h bigint, n bigint")
            if table is None:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            rows = sorted((r.h, r.n) for r in table.collect())  # at most ORDER
            self._order = np.array([h for h, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)
        return self._order

    def _first(self, sets: DataFrame, every: bool = False) -> DataFrame:
        return sets.select("g", "size", "triples").mapInArrow(_first_triples(0.0 if every else self.threshold, *self._fixed_order()), "h bigint, g bigint, size int")

    def _met(self, batch: DataFrame | Batch) -> Batch:
        if not isinstance(batch, Batch):
            if self._last is None or self._last[0] is not batch:
                self._last = (batch, Batch.of(batch))
            batch = self._last[1]
        if not batch.met:
            keys, postings, old = None if batch.keys is None else self._read("keys", "key binary"), self._read("postings", _POSTINGS), self._read("sets", _SETS)
            known = lambda: None if keys is None else written(keys.join(_held(batch.keys, batch.n_keys), "key", "left_semi").distinct())
            batch.pairs, batch.known_keys = together(lambda: None if postings is None else self._near(batch, postings, old), known)
            batch.met = True
        return batch

    def _near(self, batch: Batch, postings: DataFrame, old: DataFrame) -> DataFrame:
        """g, old of a batch's and history's sets that are near; equal for a set that history holds itself."""
        near = F.least("size", "n") >= F.greatest("size", "n") * self.threshold - 1e-9
        pairs = written(postings.join(_held(self._first(batch.sets), batch.triples), "h").filter(near).select("g", "old").distinct())
        n = stored_bytes(pairs) // 12  # two hashes, which don't compress, take 16 bytes a row
        mine = batch.sets.select("g", "size", F.col("counts").alias("p"))
        table = old.select(F.col("g").alias("old"), F.col("size").alias("n"), F.col("counts").alias("q"))
        both = table.join(_held(pairs.filter("g <> old"), n), "old").join(_held(mine, batch.n_sets, BROADCAST_SETS), "g")
        left = both.select("g", "old", "size", "n", "p", "q").mapInArrow(_pruned(self.threshold), "g bigint, old bigint")
        theirs = old.select(F.col("g").alias("old"), F.col("triples").alias("set_b")).join(_held(left, n), "old")
        both = theirs.join(batch.sets.select("g", F.col("triples").alias("set_a")), "g").select(F.col("g").alias("g_a"), F.col("old").alias("g_b"), "set_a", "set_b")
        links = verified(both, self.threshold).select(F.col("g_a").alias("g"), F.col("g_b").alias("old"))
        return written(links.unionByName(pairs.filter("g = old")))

    def check(self, batch: DataFrame | Batch) -> DataFrame:
        """id, same, near of the batch's texts that history holds already: in the same form, in nearly the same form."""
        b = self._met(batch)
        some = lambda df, column, schema: self.spark.createDataFrame([], schema) if df is None else df.select(column)
        return hits(b.rows, some(b.known_keys, "key", "key binary"), some(b.pairs, "g", "g bigint"))

    def accept(self, batch: DataFrame | Batch) -> None:
        """Appends the batch: of keys and sets those that history does not hold. What `check` found of the same batch is used again."""
        b = self._met(batch)
        self._last = None
        new, keys = b.sets, b.keys
        if b.pairs is not None:
            new = new.join(b.pairs.filter("g = old").select("g"), "g", "left_anti")
        if b.known_keys is not None:
            keys = keys.join(b.known_keys, "key", "left_anti")
        together(
            lambda: None if keys is None else self._append(keys.select("key"), "keys", b.n_keys, 4_000_000),
            lambda: self._append(self._first(new, self._order is None and not len(self._fixed_order()[0])).select("h", F.col("g").alias("old"), F.col("size").alias("n")), "postings", b.triples, 8_000_000),
        )
        # sets last: if the job dies before, they are taken as new again, and a repeated key or posting does no harm
        self._append(new.select("g", "size", "triples", "counts"), "sets", b.n_sets, 50_000)
        if not len(self._fixed_order()[0]):
            held = self._read("sets", _SETS)
            if held.count() >= ORDER_SETS:
                each = held.select("triples").mapInArrow(_exploded, "h bigint").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
                each.orderBy(F.desc("n"), "h").limit(ORDER).write.mode("overwrite").parquet(os.path.join(self.path, "order"))


def counted(df: DataFrame, *more: Column) -> tuple:
    """written(df), its number of rows, and further sums over it."""
    table = written(df)
    return table, *table.agg(F.count(F.lit(1)), *more).collect()[0]


_others = ThreadPoolExecutor(3)


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files of a written table, without a job."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def together(first: Callable, *rest: Callable) -> list:
    """Results of jobs that do not depend on each other, submitted at the same time: the first from this thread, the others from a
    few threads that stay, as each new one would leave a connection behind."""
    waiting = [_others.submit(j) for j in rest]
    return [first(), *(w.result() for w in waiting)]


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64))], names=["h"])


def _held(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df for a broadcast if it has at most `most` rows (`rows` is its number or more), else as it is."""
    return F.broadcast(df) if rows <= most else df


def month(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM")


def seen_before(uploads: DataFrame, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """file_id of uploads that some upload of an earlier month equals or nearly equals: every month, in order, is checked against the
    history of those before it and then accepted.

    uploads: id, kind, text, created_at. Uploads without created_at take no part; repeated rows of an id count in its first month
    only. Each month is encoded once, and its keys and sets are taken once. path: the folder of the history, which must be new; by default one in the shared folder, gone at the end of
    the application. The driver holds the list of months, no more.
    """
    spark = uploads.sparkSession
    place = path or f"{ensure_checkpoint_dir(spark)}/history-{os.urandom(8).hex()}"
    u = uploads.filter("created_at is not null").select("id", "kind", "text", month(F.col("created_at")).alias("month"))
    every = written(encoded(u, "month"))
    again = written(every.groupBy("id").agg(F.min("month").alias("first"), F.max("month").alias("last")).filter("first < last").select("id", "first"))
    if not again.isEmpty():
        every = written(every.join(again, "id", "left").filter("first is null or first = month").drop("first"))
    rows, (keys, sets) = every.select("id", "word_key", "field_key", "g", "month"), together(lambda: written(each_key(every, "month").select("month", "key").distinct(), "month"), lambda: written(each_set(every, "month"), "month"))
    n_keys = {r.month: r.n for r in keys.groupBy("month").agg(F.count("*").alias("n")).collect()}
    sizes = {r.month: (r.n, r.triples) for r in sets.groupBy("month").agg(F.count("*").alias("n"), F.sum("size").alias("triples")).collect()}
    history = History(spark, place, threshold)
    near = [spark.createDataFrame([], "month string, g bigint")]
    for m in sorted(n_keys):
        of = lambda df, m=m: df.filter(F.col("month") == m).drop("month")
        batch = Batch(of(rows), None, of(sets), n_keys[m], *sizes.get(m, (0, 0)))
        history.accept(batch)  # meets it with the history before
        if batch.pairs is not None:
            near.append(batch.pairs.select(F.lit(m).alias("month"), "g"))
        release(spark, 1)  # a month leaves the plans of half a dozen jobs behind
    # a key is in history from its first month on, which one pass over the narrow table of keys tells for all months
    first = written(keys.groupBy("key").agg(F.min("month").alias("since")))
    known = keys.join(first, "key").filter("month > since").select("month", "key")
    if path is not None:
        history._append(first.select("key"), "keys", sum(n_keys.values()), 4_000_000)
    else:
        p = spark._jvm.org.apache.hadoop.fs.Path(place)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    # what each month was found to have in history is in tables, so the rows are told in one go
    return hits(rows, known, reduce(DataFrame.unionByName, near), "month").select(F.col("id").alias("file_id"))
