"""Duplicates hidden by formatting: records that differ only in white space, letter case, punctuation or field order.

Canonical bytes of a text are a tag and 16 bytes: 's' with the digest of its sequence of words, or 'f' with the digest of its
sorted fields (texts of type text that consist of named fields only). They are counted by recursive radix partitioning: a
bucket is a prefix of the bytes; a bucket that holds too many entries is split by its next byte until it fits or holds one
key only; then one task counts the bucket in a trie with terminal counters. Entries are combined before they travel, so the
copies of one text, however many, reach the trie as one entry per batch of rows. Prefixes stay in tables: the driver sees none.

Two records are copies if they share a key of either kind, and a class is what is connected by copies: word keys that a field key
holds together are one class.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.llm.components import components
from marquetry.llm.kernels import Words, text_chunks
from marquetry.llm.records import TEXT_KIND
from marquetry.session import written

#: Entries that one trie may hold.
BUCKET_ENTRIES = 200_000
#: Members of a group that one task pairs with all others.
PAIR_BLOCK = 2_000
KEY_BYTES = 17

_WORD = re.compile(r"[^\W_]+")
_FIELD = re.compile(r"""^\W*?(?P<name>[^\W\d_][^\W_]*(?:[ _-]+[^\W_]+){0,3})["'\]})>*]*\s*(?:=>|->|:|=|\t|\|)\s*(?P<value>.*)$""", re.S)
_TAG = re.compile(r"^\s*<(?P<name>\w+)>(?P<value>[^<]*)</(?P=name)>\s*$")


def _words(s: object) -> str:
    return " ".join(_WORD.findall(str(s).casefold()))


def _json_fields(text: str) -> list[tuple[str, str]] | None:
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
        v = [p for x in v for p in x.items()]
    elif isinstance(v, dict):
        v = list(v.items())
    else:
        return None
    return None if any(isinstance(x, (dict, list)) for _, x in v) else [(_words(k), _words("" if x is None else x)) for k, x in v]


def fields_of(text: str) -> list[tuple[str, str]] | None:
    """(name, value) of a text that consists of at least two named fields with different names and nothing else; else None.

    Layouts: a JSON object; lines or ';'-separated parts 'name: value', 'name = value', '[name] TAB value', 'name | value',
    'name -> value', with bullets or quotes around; lines '<name>value</name>'.
    """
    t = text.strip()
    found = _json_fields(t) if t[:1] in ("{", "[") else None
    if found is None:
        parts = [p for p in re.split(r"[\r\n]+", t) if p.strip()]
        if len(parts) == 1:
            parts = [p for p in t.split(";") if p.strip()]
        found = []
        for p in parts:
            m = _TAG.match(p) or _FIELD.match(p)
            if not m:
                return None
            found.append((_words(m["name"]), _words(m["value"])))
    names = [k for k, _ in found]
    return found if len(found) > 1 and len(set(names)) == len(names) and all(names) else None


def field_key(text: str) -> bytes | None:
    f = fields_of(text)
    return None if f is None else b"f" + blake2b("\x1e".join(sorted(f"{k}\x1f{v}" for k, v in f)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, kinds, texts = (c.to_pylist() for c in b.columns)
        keep = [i for i, t in enumerate(texts) if t is not None and t.strip() and ids[i] is not None]
        ids, kinds, texts = ([x[i] for i in keep] for x in (ids, kinds, texts))
        rows: list[tuple[str, bytes, bytes | None]] = []
        for a, z in text_chunks(texts):
            for i, digest in zip(range(a, z), Words(texts[a:z]).sequence_digests()):
                f = field_key(texts[i]) if kinds[i] == TEXT_KIND else None
                rows.append((ids[i], b"s" + digest, f))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["id", "word_key", "field_key"])


def both_keys(df: DataFrame) -> DataFrame:
    """id, word_key, field_key (null where the text has none) of each record; df: id, kind, text.

    Null ids and blank texts are left out; a text without any word has the key of the empty sequence. Repeated rows of an id
    become one (should their texts differ, the one of least keys). Extra columns are ignored.
    """
    keys = df.select("id", "kind", "text").mapInArrow(_keys, "id string, word_key binary, field_key binary")
    return keys.groupBy("id").agg(F.min(F.struct("word_key", "field_key")).alias("k")).select("id", "k.word_key", "k.field_key")


def listed(both: DataFrame) -> DataFrame:
    """id, key: one row for each key of a record."""
    return both.select("id", F.explode(F.array_compact(F.array("word_key", "field_key"))).alias("key"))


def canonical_keys(df: DataFrame) -> DataFrame:
    """id, key of each record: its word key, and its field key where it has one (see both_keys)."""
    return listed(both_keys(df))


def _prefix(depth: int) -> Column:
    return F.substring("key", 1, depth)


def radix_levels(keys: DataFrame, entries: int = BUCKET_ENTRIES) -> list[DataFrame]:
    """Prefixes that recursive splitting gives, one table (p, n, split) a level: buckets with their entries, and those that hold
    too many and are split on the next level. Every key has exactly one prefix that is a bucket.

    Each level is one pass over the narrow key table that counts the next byte under the oversized prefixes only. The tables
    stay in the shared folder; the driver learns only whether a level has a split."""
    levels: list[DataFrame] = []
    part = keys
    for depth in range(1, KEY_BYTES + 1):
        fits = (F.count("*") <= entries) | (F.min("key") == F.max("key")) | F.lit(depth == KEY_BYTES)
        levels.append(written(part.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n"), (~fits).alias("split"))))
        open_ = levels[-1].filter("split")
        if open_.isEmpty():
            break
        part = keys.join(open_.select("p"), _prefix(depth) == F.col("p"), "left_semi")
    return levels


def with_buckets(keys: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """keys with `bucket`, the prefix that is theirs."""
    out = keys.withColumn("bucket", _prefix(1))
    for depth, level in enumerate(levels[:-1], 1):
        split = level.filter("split").select(F.col("p").alias(f"_p{depth}"))
        out = out.join(split, _prefix(depth) == F.col(f"_p{depth}"), "left").withColumn("bucket", F.when(F.col(f"_p{depth}").isNotNull(), _prefix(depth + 1)).otherwise(F.col("bucket"))).drop(f"_p{depth}")
    return out


class Trie:
    """Path-compressed trie over byte strings with a counter and the least id at each terminal."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [{}, None]

    def add(self, key: bytes, count: int, least: str) -> None:
        node = self.root
        while key:
            edge = node[0].get(key[0])
            if edge is None:
                node[0][key[0]] = edge = [key, [{}, None]]
            label = edge[0]
            if not key.startswith(label):
                n = next((i for i, (x, y) in enumerate(zip(label, key)) if x != y), min(len(label), len(key)))
                edge[0], edge[1] = label[:n], [{label[n]: [label[n:], edge[1]]}, None]
                label = label[:n]
            node, key = edge[1], key[len(label) :]
        node[1] = (count, least) if node[1] is None else (node[1][0] + count, min(node[1][1], least))

    def items(self, prefix: bytes = b"") -> Iterator[tuple[bytes, int, str]]:
        stack = [(prefix, self.root)]
        while stack:
            at, node = stack.pop()
            if node[1] is not None:
                yield at, *node[1]
            stack += [(at + label, child) for label, child in node[0].values()]


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch one entry for each key: bucket, key, rows, least id."""
    for b in batches:
        seen: dict[tuple[bytes, bytes], list] = {}
        for i, k, at in zip(*(c.to_pylist() for c in b.columns)):
            e = seen.setdefault((at, k), [0, i])
            e[0] += 1
            e[1] = min(e[1], i)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at for at, _ in seen], pa.binary()), pa.array([k for _, k in seen], pa.binary()), pa.array([e[0] for e in seen.values()], pa.int64()), pa.array([e[1] for e in seen.values()], pa.string())], names=["bucket", "key", "n", "id"]
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[bytes, Trie] = {}
    for b in batches:
        for bucket, k, n, i in zip(*(c.to_pylist() for c in b.columns)):
            tries.setdefault(bucket, Trie()).add(k, n, i)
    for t in tries.values():
        rows = list(t.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["key", "copies", "first_id"])


def count_keys(keys: DataFrame, entries: int = BUCKET_ENTRIES) -> DataFrame:
    """key, copies, first_id of the rows (id, key): radix buckets, then tries. keys is read once per level: give a written table."""
    keys = keys.select("id", "key")
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys.count() // entries)
    sent = with_buckets(keys, radix_levels(keys, entries)).mapInArrow(_combined, "bucket binary, key binary, n bigint, id string")
    return sent.repartitionById(parts, F.pmod(F.xxhash64("bucket"), F.lit(parts)).cast("int")).mapInArrow(_count, "key binary, copies bigint, first_id string")


def group_pairs(members: DataFrame, block: int = PAIR_BLOCK, differ: str | None = None) -> DataFrame:
    """All pairs id_a < id_b of rows (key, id, copies) of equal key, with `differ` only those of different values in that column. A
    group of more than `block` members is salted: each salt holds a part of its members on one side and all of them on the other, so
    the pairs of a hot group spread over many tasks."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("copies") / block)).cast("int")
    value = F.col(differ) if differ else F.lit(None).cast("string")
    a = members.select("key", F.col("id").alias("id_a"), value.alias("v_a"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    b = members.select(F.col("key").alias("k"), F.col("id").alias("id_b"), value.alias("v_b"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("s"))
    test = (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s")) & (F.col("id_a") < F.col("id_b"))
    return a.join(b, test & (F.col("v_a") != F.col("v_b")) if differ else test).select("id_a", "id_b")


def same_text_pairs(df: DataFrame, entries: int = BUCKET_ENTRIES) -> DataFrame:
    """id_a, id_b: all pairs of records with equal word key or equal field key."""
    keys = written(canonical_keys(df))
    repeated = count_keys(keys, entries).filter("copies > 1").select(F.col("key").alias("k"), "copies")
    members = keys.join(repeated, F.col("key") == F.col("k")).select("key", "id", "copies")
    return group_pairs(members).distinct()


def collapsed(df: DataFrame, entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per class of copies: record_id (the least id of the class), copies. A class is a component of same_text_pairs.

    Records are counted by word key; classes of word keys that field keys connect are then added up, so no pair is formed."""
    both = written(both_keys(df))
    counted = count_keys(both.select("id", F.col("word_key").alias("key")), entries)
    edges = both.filter("field_key is not null").select(F.hex("word_key").alias("a"), F.hex("field_key").alias("b")).distinct()
    # a field key whose word key nobody else shares through another field key connects nothing
    able = edges.join(edges.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").select("b"), "b", "left_semi")
    able = written(able.select("a", "b"))
    comp = components(able.select(F.col("a").alias("node")).unionByName(able.select(F.col("b").alias("node"))), able)
    out = counted.join(comp, F.hex("key") == F.col("node"), "left")
    return out.groupBy(F.coalesce("component", F.hex("key")).alias("c")).agg(F.min("first_id").alias("record_id"), F.sum("copies").alias("copies")).select("record_id", "copies")
