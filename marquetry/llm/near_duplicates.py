"""Near-duplicate records: sets of word triples whose Jaccard similarity reaches a threshold, exactly.

Pigeonhole over the universe of triples: two sets of sizes a <= b with similarity t share all but (1-t)a of the smaller one,
so in any common order of the universe they meet within the first a - ceil(t*a) + 1 triples of either. Each triple is a
segment of its own, and the segments to index are allocated by cost: rarest document frequency first.

1. Packs send the distinct hashes of their records' triples, combined per pack, to buckets by hash; buckets return the cost
   class of each (1: this record only). A triple of class 1 costs nothing but counts against the record, so a record whose
   own triples exceed the allowance leaves here, before anything of it is indexed. With the triples go the digests of the
   pack's sets, and buckets return which of them are the pack's to index: each different set is one pack's.
2. Packs index the allocated triples of the remaining sets - one entry per different set, however many records of whatever
   packs have it - and store those sets once.
3. Buckets pair the sets that meet under a triple, filtered by size and by position; pairs are verified on the whole sets. A
   triple under which very many different sets meet leaves its bucket in cells - a block of its list against another - that
   tasks elsewhere pair.

What travels is packed: texts as compressed blocks, hashes sent for pricing as compressed gaps of sorted 28-bit values, index entries
as 32 bits of hash and a rank, with the set named once per bucket. A clash of bits only adds a candidate, which verification drops.
Packs and buckets grow with the records so that what a pack sends to a bucket stays of use to a compressor, and each step's
results are written, and the shuffles before them let go, before the next step begins; candidates are verified in rounds, so
that the sets that travel with them are never much more than the sets there are.

Frequencies, allocation and verification cover all records; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.llm.components import components
from marquetry.llm.copies import PAIR_BLOCK, group_pairs
from marquetry.llm.kernels import U, Words, mix, text_chunks
from marquetry.llm.records import packed, rows_of
from marquetry.llm.shared_spans import _groups, _split
from marquetry.session import cut, release, written

THRESHOLD = 0.6
#: Records of a pack, packs of a task, and packs for each bucket.
PACK_ROWS = 2_000
PACKS_PER_TASK = 4
PACKS_PER_BUCKET = 8
#: The sets that travel with the candidates of a round of verification, as a multiple of all sets.
ROUND_SETS = 1.0
#: Entries that are paired with their partners at once: bounds the memory of a task.
LIST_BLOCK = 4096
#: A triple's list of more different sets than this is split into cells; at most this many blocks, larger where the list is longer.
HOT_LIST = 20_000
HOT_BLOCKS = 64
_I = np.int64


class _Pack:
    """Triples of a pack's records: owner, hash, and the pack's distinct hashes with their counts."""

    def __init__(self, table: pa.Table, buckets: int) -> None:
        self.ids, texts = rows_of(table)
        docs, hashes, self.sequence = [np.zeros(0, _I)], [np.zeros(0, U)], []
        for a, z in text_chunks(texts):
            w = Words(texts[a:z])
            d, h = w.triples()
            docs.append(d + a), hashes.append(h), self.sequence.extend(w.sequence_digests())
        self.doc, self.hash = np.concatenate(docs), np.concatenate(hashes)
        values, self.at, self.count = np.unique(self.hash, return_inverse=True, return_counts=True)
        self.values = values
        self.parts = {b: x[np.argsort(_priced(values[x]), kind="stable")] for b, x in _split(values, buckets)}  # bucket -> positions among the distinct hashes
        self.sizes = np.bincount(self.doc, minlength=len(self.ids))
        self.g = set_digest(self.doc, self.hash, len(self.ids))
        self.sets = np.unique(self.g[self.sizes > 0])
        self.set_parts = dict(_split(self.sets, buckets))  # bucket -> positions among the different sets


def _short(h: np.ndarray) -> np.ndarray:
    """32 bits of a hash besides the bits that choose the bucket."""
    return (h & U(0xFFFFFFFF)).astype(np.uint32)


def _priced(h: np.ndarray) -> np.ndarray:
    """28 bits of a hash besides the bits that choose the bucket; a chance clash only makes a triple look less rare."""
    return (h & U(0xFFFFFFF)).astype(np.uint32)


def gaps(sorted_values: np.ndarray) -> bytes:
    """Sorted 32-bit values as their differences, 3 bytes each where all differences fit, else 4; a first byte says which."""
    d = np.diff(sorted_values, prepend=np.uint32(0)).astype(np.uint32)
    if len(d) and d.max() >= 1 << 24:
        return b"4" + d.tobytes()
    return b"3" + (d & np.uint32(0xFFFF)).astype(np.uint16).tobytes() + (d >> np.uint32(16)).astype(np.uint8).tobytes()


def from_gaps(data: bytes, n: int) -> tuple[np.ndarray, int]:
    """The n values of gaps(), and the bytes they took."""
    if data[:1] == b"4":
        return np.cumsum(np.frombuffer(data, np.uint32, n, 1), dtype=np.uint32), 1 + 4 * n
    d = np.frombuffer(data, np.uint16, n, 1).astype(np.uint32) | (np.frombuffer(data, np.uint8, n, 1 + 2 * n).astype(np.uint32) << np.uint32(16))
    return np.cumsum(d, dtype=np.uint32), 1 + 3 * n


def _send(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        p = _Pack(table, buckets)
        out, none = [], np.zeros(0, _I)
        for b in sorted(p.parts.keys() | p.set_parts.keys()):
            x, sets = p.parts.get(b, none), p.sets[p.set_parts.get(b, none)]
            whole = gaps(_priced(p.values[x])) + np.minimum(p.count[x], 255).astype(np.uint8).tobytes()
            out.append((b, np.array([len(x), len(sets), len(whole)], np.uint32).tobytes() + sets.tobytes() + pa.compress(whole, codec="zstd", asbytes=True)))
        pack = table.column("pack")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "pack": pa.array([pack] * len(out), pa.int32()), "payload": pa.array([x for _, x in out], pa.binary())})

    return run


def _price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pack the cost class of every hash sent (its frequency up to 127, then by powers of two), compressed, behind a byte
    for every set sent: whether it is this pack's, the least that has it."""
    packs, parts, counts, sets = [], [], [], []
    bucket = None
    for b in batches:
        for at, pack, p in zip(*(c.to_pylist() for c in b.columns)):
            n, m, size = (int(x) for x in np.frombuffer(p, np.uint32, 3))
            whole = pa.decompress(memoryview(p)[12 + 8 * m :], decompressed_size=size, codec="zstd", asbytes=True)
            values, used = from_gaps(whole, n)
            bucket = at
            packs.append(pack)
            parts.append(values)
            counts.append(np.frombuffer(whole, np.uint8, n, used))
            sets.append(np.frombuffer(p, U, m, 12))
    if not parts:
        return
    lengths = [len(x) for x in parts]
    _, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts)).astype(_I)
    cost = np.where(total < 128, total, 121 + np.log2(np.maximum(total, 1)).astype(_I)).astype(np.uint8)[at]
    cuts = np.cumsum([0, *lengths])
    g, of = np.concatenate(sets), np.repeat(packs, [len(x) for x in sets])
    o = np.lexsort((of, g))
    own = np.zeros(len(g), np.uint8)
    own[o] = np.concatenate([[True], g[o][1:] != g[o][:-1]])[: len(g)]
    of_sets = np.cumsum([0, *map(len, sets)])
    for k in range(0, len(packs), 256):
        some = range(k, min(k + 256, len(packs)))
        payload = [own[of_sets[i] : of_sets[i + 1]].tobytes() + pa.compress(cost[cuts[i] : cuts[i + 1]].tobytes(), codec="zstd", asbytes=True) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array([packs[i] for i in some], pa.int32()), pa.array([bucket] * len(some), pa.int32()), pa.array(payload, pa.binary())], names=["pack", "bucket", "payload"])


_OUT = "kind int, bucket int, id string, g bigint, size int, payload binary"


def set_digest(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """64 bits for each set, whatever the order of its members."""
    out = np.zeros(docs, U)
    with np.errstate(over="ignore"):
        np.add.at(out, doc, mix(h ^ U(0xA0761D6478BD642F)))
    return mix(out)


def _entries(h: np.ndarray, g: np.ndarray, size: np.ndarray, rank: np.ndarray) -> bytes:
    """Index entries of a bucket; those of a set stand together, and the set is named once."""
    new = np.concatenate([[True], g[1:] != g[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(g)]]))
    kind = np.uint16 if rank.max(initial=0) < 1 << 16 else np.uint32
    head = np.array([len(first), len(h), np.dtype(kind).itemsize], np.uint32)
    return head.tobytes() + g[first].tobytes() + size[first].astype(np.uint32).tobytes() + n.astype(np.uint32).tobytes() + h.tobytes() + rank.astype(kind).tobytes()


def _read_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sets, entries, width = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    g = np.frombuffer(data, U, sets, 12)
    size, n = np.frombuffer(data, np.uint32, 2 * sets, 12 + 8 * sets).reshape(2, sets)
    at = 12 + 16 * sets
    h = np.frombuffer(data, np.uint32, entries, at)
    rank = np.frombuffer(data, np.uint16 if width == 2 else np.uint32, entries, at + 4 * entries)
    return h, np.repeat(g, n), np.repeat(size, n).astype(_I), rank.astype(_I)


def _index(buckets: int, threshold: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Rows of kind 0: a record and its set g (payload: word-sequence digest); 1: a set; 2: index entries for a bucket."""

    def run(_key: tuple, table: pa.Table, prices: pa.Table) -> pa.Table:
        names = ["kind", "bucket", "id", "g", "size", "payload"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
        rows: list[tuple] = []
        if table.num_rows:
            p = _Pack(table, buckets)
            cost, own, none = np.ones(len(p.values), np.uint8), np.zeros(len(p.sets), bool), np.zeros(0, _I)
            for b, x in zip(prices.column("bucket").to_pylist(), prices.column("payload").to_pylist()):
                values, sets = p.parts.get(b, none), p.set_parts.get(b, none)
                own[sets] = np.frombuffer(x, np.uint8, len(sets)) > 0
                cost[values] = np.frombuffer(pa.decompress(memoryview(x)[len(sets) :], decompressed_size=len(values), codec="zstd", asbytes=True), np.uint8)
            cost, g = cost[p.at], p.g
            least = np.ceil(threshold * p.sizes - 1e-9).astype(_I)
            allowance = p.sizes - least + 1
            o = np.lexsort((p.hash, cost, p.doc))
            doc, h, c = p.doc[o], p.hash[o], cost[o]
            start = np.cumsum(p.sizes) - p.sizes
            rank = np.arange(len(doc)) - start[doc]
            use = (rank < allowance[doc]) & (c > 1)
            alive = np.zeros(len(p.ids), bool)
            alive[doc[use]] = True
            alive |= p.sizes == 0  # fewer than three words: pairs by equal word sequence only
            gs = g.view(_I)
            for i in np.flatnonzero(alive):
                rows.append((0, None, p.ids[i], int(gs[i]), int(p.sizes[i]), p.sequence[i]))
            # one set of each kind is indexed and stored, the one of the least record of the least pack; its copies elsewhere have the
            # same prices, so they are alive alike
            live = np.flatnonzero(alive & (p.sizes > 0))
            live = live[own[np.searchsorted(p.sets, g[live])]]
            _, one = np.unique(g[live], return_index=True)
            first = np.zeros(len(p.ids), bool)
            first[live[one]] = True
            for i in live[one]:
                rows.append((1, None, None, int(gs[i]), int(p.sizes[i]), p.hash[start[i] : start[i] + p.sizes[i]].tobytes()))
            use &= first[doc]
            doc, h, rank = doc[use], h[use], rank[use]
            for b, x in _split(h, buckets):
                rows.append((2, b, None, None, None, _entries(_short(h[x]), g[doc[x]], p.sizes[doc[x]], rank[x])))
        return pa.table({n: pa.array(col, t) for n, t, col in zip(names, types, zip(*rows) if rows else [[]] * 6)})

    return run


def _paired(h: np.ndarray, g: np.ndarray, size: np.ndarray, rank: np.ndarray, threshold: float, side: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs of entries of equal h that can still reach the threshold by size and by position; with `side`, of different sides only.

    Entries are sorted by h, then size, and walked in blocks of LIST_BLOCK against the partners behind them that are near enough
    in size, so memory stays bounded however long a list is."""
    group, _, last = _groups(h)
    end = last[group] + 1
    todo = np.flatnonzero(np.arange(len(h)) < end - 1)
    found: list[np.ndarray] = []
    held = 0
    for k in range(0, len(todo), LIST_BLOCK):
        i = todo[k : k + LIST_BLOCK]
        # partners stand behind i in the list; sizes increase, so they end where size exceeds size_i / threshold
        limit = np.floor(size[i] / threshold + 1e-9)
        lo, hi = i + 1, end[i].copy()
        while (lo < hi).any():
            mid = (lo + hi) // 2
            ok = (lo < hi) & (size[np.minimum(mid, len(size) - 1)] <= limit)
            lo, hi = np.where(ok, mid + 1, lo), np.where(ok | (lo >= hi), hi, mid)
        n = lo - i - 1
        for piece in np.array_split(np.arange(len(i)), max(1, int(n.sum()) // 2_000_000)):
            m = n[piece]
            a = np.repeat(i[piece], m)
            b = a + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            need = np.ceil(threshold / (1 + threshold) * (size[a] + size[b]) - 1e-9)
            # this triple may be the first they share or a later one: those before it are at most min(rank) more
            ok = np.minimum(size[a] - rank[a], size[b] - rank[b]) + np.minimum(rank[a], rank[b]) >= need
            if side is not None:
                ok &= side[a] != side[b]
            x, y = np.minimum(g[a[ok]], g[b[ok]]), np.maximum(g[a[ok]], g[b[ok]])
            if len(x):
                found.append(np.unique(np.stack([x, y], 1), axis=0))
                held += len(found[-1])
            if held > 1_000_000:
                yield _pairs(found)
                found, held = [], 0
    if found:
        yield _pairs(found)


_MET = "g_a bigint, g_b bigint, cell binary"


def _cells(h: int, g: np.ndarray, size: np.ndarray, rank: np.ndarray, hot: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The list of one hot triple (sorted by size) as cells, each a block against itself or a later one; g_a and g_b of a cell
    only spread the cells over tasks. Blocks too far apart in size have no cell."""
    blocks = min(HOT_BLOCKS, len(g), -(-len(g) // hot) + 1)
    cuts = np.linspace(0, len(g), blocks + 1).astype(int)
    for i in range(blocks):
        for j in range(i, blocks):
            a, b = slice(cuts[i], cuts[i + 1]), slice(cuts[j], cuts[j + 1])
            if size[b][0] > size[a][-1] / threshold + 1e-9:
                break
            parts = [np.concatenate([v[a], v[b]]) if i < j else v[a] for v in (g, size.astype(U), rank.astype(U))]
            head = np.array([len(parts[0]), cuts[i + 1] - cuts[i] if i < j else 0], U)
            yield pa.RecordBatch.from_arrays([pa.array([int(h)], pa.int64()), pa.array([i * blocks + j], pa.int64()), pa.array([head.tobytes() + np.stack(parts).tobytes()], pa.binary())], names=["g_a", "g_b", "cell"])


def _meet(threshold: float, hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (g_a, g_b) of different sets that meet under a triple of the bucket, or cells of triples where more than `hot` do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_read_entries(x) for b in batches for x in b.column(0).to_pylist()]
        if not parts:
            return
        h, g, size, rank = (np.concatenate(x) for x in zip(*parts))
        del parts
        o = np.lexsort((g, size, h))
        h, g, size, rank = h[o], g[o], size[o], rank[o]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        h, g, size, rank = h[once], g[once], size[once], rank[once]
        _, first, last = _groups(h)
        long = last - first >= hot
        for a, z in zip(first[long], last[long] + 1):
            yield from _cells(int(h[a]), g[a:z], size[a:z], rank[a:z], hot, threshold)
        few = ~np.repeat(long, last - first + 1)
        yield from _paired(h[few], g[few], size[few], rank[few], threshold)

    return run


def _open_cells(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Passes pairs on and pairs what is in cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = b.filter(b.column(2).is_null())
            yield plain.select([0, 1])
            for x in b.column(2).drop_null().to_pylist():
                n, left = (int(v) for v in np.frombuffer(x, U, 2))
                g, size, rank = np.frombuffer(x, U, offset=16).reshape(3, n)
                side = (np.arange(n) < left).astype(np.uint8)
                o = np.lexsort((g, size))
                for pairs in _paired(np.zeros(n, np.uint32), g[o], size[o].astype(_I), rank[o].astype(_I), threshold, side[o] if left else None):
                    yield pairs.select([0, 1])

    return run


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.concatenate(found), axis=0).view(_I)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1])), pa.nulls(len(p), pa.binary())], names=["g_a", "g_b", "cell"])


def _verify(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep, sim = [], []
            for i in range(len(a)):
                p, q = np.frombuffer(x[i], U), np.frombuffer(y[i], U)
                common = len(np.intersect1d(p, q, assume_unique=True))
                s = common / (len(p) + len(q) - common)
                if s >= threshold:
                    keep.append(i), sim.append(s)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array(sim, pa.float64())], names=["g_a", "g_b", "similarity"])

    return run


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """g_a, g_b, similarity of pairs (g_a, g_b, set_a, set_b: 64-bit triples, packed) that reach the threshold."""
    return pairs.select("g_a", "g_b", "set_a", "set_b").mapInArrow(_verify(threshold), "g_a bigint, g_b bigint, similarity double")


class SetJoin:
    """The self join of df (id, text): `members` (id, g, size, sequence digest), and `links` (g_a, g_b, similarity) between different sets.

    Records that can have no partner are in neither. Null ids and blank texts are ignored, repeated rows of an id are one
    record (should their texts differ, the greatest counts), texts of fewer than three words have the empty set and take no part in links. Extra columns are ignored.
    Prices, index, met pairs and links are written to the shared folder, so what a step exchanged is gone before the next one.
    """

    def __init__(self, df: DataFrame, rows: int, threshold: float = THRESHOLD, hot: int = HOT_LIST) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        spark = df.sparkSession
        texts, packs, parts = packed(df.select("id", "text").filter("id is not null and text is not null"), rows, PACK_ROWS, PACKS_PER_TASK)
        buckets = max(parts, packs // PACKS_PER_BUCKET)
        sent = texts.groupBy("pack").applyInArrow(_send(buckets), "bucket int, pack int, payload binary")
        priced = written(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_price, "pack int, bucket int, payload binary"))
        release(spark)  # what was sent; the texts are exchanged again, which costs less than to hold both
        priced = priced.repartition(parts, "pack")
        index = written(texts.groupBy("pack").cogroup(priced.groupBy("pack")).applyInArrow(_index(buckets, threshold), _OUT), "kind")
        release(spark)  # texts and prices are not needed any more
        self.members = index.filter("kind = 0").select("id", "g", "size", F.col("payload").alias("sequence"))
        self.sets = index.filter("kind = 1").select("g", "size", "payload")
        met = index.filter("kind = 2").repartitionById(buckets, F.col("bucket")).select("payload").mapInArrow(_meet(threshold, hot), _MET).distinct()
        # a pair from a cell may also have met elsewhere
        self.met = written(met.mapInArrow(_open_cells(threshold), "g_a bigint, g_b bigint").distinct())
        release(spark)
        self.links = self._verified(threshold)

    def _verified(self, threshold: float) -> DataFrame:
        """The pairs of met that reach the threshold. A pair takes its first set along, so many pairs are verified in several rounds."""
        spark = self.met.sparkSession
        n, triples = self.sets.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).collect()[0]
        rounds = max(1, -int(-self.met.count() // (ROUND_SETS * max(n, 1))))
        a, b = (self.sets.select(F.col("g").alias(f"g_{x}"), F.col("payload").alias(f"set_{x}")) for x in "ab")
        found = []
        for k in range(rounds):
            some = self.met if rounds == 1 else self.met.filter(F.pmod(F.xxhash64("g_a", "g_b"), F.lit(rounds)) == k)
            found.append(written(verified(some.join(a, "g_a").join(b, "g_b"), threshold)))
            release(spark)
        return reduce(DataFrame.unionByName, found)


def near_pairs(df: DataFrame, rows: int, threshold: float = THRESHOLD, block: int = PAIR_BLOCK, hot: int = HOT_LIST) -> DataFrame:
    """id_a, id_b: all pairs of records with similarity >= threshold, or (texts of fewer than three words) equal word sequences.

    Copies of a set are salted, `block` records to a salt, for the pairs among them and for those of two linked sets alike."""
    j = SetJoin(df, rows, threshold, hot)
    m = j.members.withColumn("key", F.when(F.col("size") > 0, F.col("g").cast("string").cast("binary")).otherwise(F.col("sequence")))
    copies = m.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("copies")).filter("copies > 1")
    same = group_pairs(m.join(copies, F.col("key") == F.col("k")).select("key", "id", "copies"), block)
    many = j.members.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("g", F.ceil(F.col("n") / block).cast("int").alias("salts"))
    salted = j.members.select("g", "id").join(many, "g", "left").select("g", "id", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    ends = j.links.select("g_a", "g_b").join(many.select(F.col("g").alias("g_a"), F.col("salts").alias("of_a")), "g_a", "left").join(many.select(F.col("g").alias("g_b"), F.col("salts").alias("of_b")), "g_b", "left")
    ends = ends.select("g_a", "g_b", "of_b", each(F.col("of_a")).alias("salt_a")).select("g_a", "g_b", "salt_a", each(F.col("of_b")).alias("salt_b"))
    a, b = (salted.select(F.col("g").alias(f"g_{x}"), F.col("salt").alias(f"salt_{x}"), F.col("id").alias(y)) for x, y in (("a", "x"), ("b", "y")))
    linked = ends.join(a, ["g_a", "salt_a"]).join(b, ["g_b", "salt_b"]).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return same.unionByName(linked)


def near_groups(df: DataFrame, rows: int, threshold: float = THRESHOLD) -> DataFrame:
    """One row per record: record_id, group_id (the least id of the records it is connected with), copies (records with the
    same triples, itself included), links (different sets near its own). Records without partner form a group of their own;
    texts of fewer than three words are grouped by equal word sequence. Nothing is expanded into pairs of records."""
    j = SetJoin(df, rows, threshold)
    links = cut(j.links.select("g_a", "g_b"))
    ends = links.select(F.col("g_a").alias("g")).unionByName(links.select(F.col("g_b").alias("g")))
    degree = ends.groupBy("g").agg(F.count("*").alias("links"))
    linked = components(degree.select(F.col("g").alias("node")), links.toDF("a", "b")).withColumnRenamed("node", "g")
    m = j.members.join(degree, "g", "left").join(linked, "g", "left")
    key = F.when(F.col("size") > 0, F.concat(F.lit("g"), F.coalesce("component", "g"))).otherwise(F.concat(F.lit("s"), F.hex("sequence")))
    own = F.when(F.col("size") > 0, F.concat(F.lit("g"), F.col("g"))).otherwise(F.concat(F.lit("s"), F.hex("sequence")))
    m = cut(m.select("id", key.alias("key"), own.alias("own"), F.coalesce("links", F.lit(0)).alias("links")))
    group = m.groupBy("key").agg(F.min("id").alias("group_id"))
    copies = m.groupBy("own").agg(F.count("*").alias("copies"))
    found = m.join(group, "key").join(copies, "own").select("id", "group_id", "copies", "links")
    every = df.select("id").filter(F.col("id").isNotNull() & F.col("text").rlike(r"\S")).distinct()
    return every.join(found, "id", "left").select(F.col("id").alias("record_id"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
