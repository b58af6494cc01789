"""The record view: rows of analyses and uploaded_files with text, one per id, spread over packs by id.

A pack is a group of records whose ids hash to the same number. It is the unit that vectorised kernels work on, and the
address to which results about a record are sent back: it depends on the id only, never on the order of rows or on which
executor computed it, so lost tasks are recomputed alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.text import trimmed

PACK_ROWS = 1000
PACKS_PER_TASK = 8
TEXT_KIND = "text"


def records(spark: SparkSession, sf_dir: str, uploads_only: bool = False) -> DataFrame:
    """id, kind ('a' for analyses, else the declared file type), text, created_at. Rows without id, and without a text of
    more than white space, are left out; repeated rows are still there (pack_groups removes them)."""
    u = spark.read.parquet(f"{sf_dir}/uploaded_files.parquet").select("id", F.coalesce(F.lower(trimmed(F.col("file_type"))), F.lit("")).alias("kind"), F.col("content").alias("text"), "created_at")
    if not uploads_only:
        a = spark.read.parquet(f"{sf_dir}/analyses.parquet").select("id", F.lit("a").alias("kind"), F.col("code").alias("text"), "created_at")
        u = a.unionByName(u)
    return u.filter(F.col("id").isNotNull() & F.col("text").rlike(r"\S"))


def row_count(spark: SparkSession, sf_dir: str, *tables: str) -> int:
    """Rows of tables, from the files' footers."""
    return sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in tables)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (id, text, pack) of a batch that go to one pack as one compressed block; see rows_of."""
    for b in batches:
        pack = b.column(2).to_numpy()
        order = np.argsort(pack, kind="stable")
        pack = pack[order]
        first = np.flatnonzero(np.concatenate([[True], pack[1:] != pack[:-1]])) if len(pack) else np.zeros(0, np.int64)
        columns = []
        for c in b.columns[:2]:
            c = c.cast(pa.string()).take(pa.array(order))
            _, offsets, data = c.buffers()
            at = np.frombuffer(offsets, np.int32, len(c) + 1, 4 * c.offset)
            columns.append((at, memoryview(data) if data is not None else memoryview(b"")))
        blocks = []
        for a, z in zip(first, [*first[1:], len(pack)]):
            parts = [np.diff(at[a : z + 1]).tobytes() for at, _ in columns] + [data[at[a] : at[z]] for at, data in columns]
            whole = b"".join(parts)
            blocks.append(np.array([z - a, len(whole)], np.int64).tobytes() + pa.compress(whole, codec="zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(pack[first], pa.int32()), pa.array(blocks, pa.binary())], names=["pack", "block"])


def rows_of(table: pa.Table) -> tuple[list[str], list[str]]:
    """ids (sorted) and texts of a pack's records: blank texts left out, repeated rows of an id taken once, with the greatest text."""
    rows: dict[str, str] = {}
    if "block" in table.column_names:
        for block in table.column("block").to_pylist():
            n, size = (int(x) for x in np.frombuffer(block, np.int64, 2))
            whole = pa.decompress(memoryview(block)[16:], decompressed_size=size, codec="zstd", asbytes=True)
            lengths = np.frombuffer(whole, np.int32, 2 * n)
            cuts = 8 * n + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            for k in range(n):
                i = whole[cuts[k] : cuts[k + 1]].decode("utf-8", "surrogatepass")
                t = whole[cuts[n + k] : cuts[n + k + 1]].decode("utf-8", "surrogatepass")
                if t.strip():
                    rows[i] = max(t, rows.get(i, t))
    else:
        for i, t in zip(table.column("id").to_pylist(), table.column("text").to_pylist()):
            if t is not None and t.strip():
                rows[i] = max(t, rows.get(i, t))
    ids = sorted(rows)
    return ids, [rows[i] for i in ids]


def packed(df: DataFrame, rows: int, per_pack: int = PACK_ROWS, per_task: int = PACKS_PER_TASK) -> tuple[DataFrame, int, int]:
    """(pack, block) of df (id, text; neither null), exchanged once by pack; the number of packs and of partitions.

    Rows travel as compressed blocks, one for each pack that a batch has rows of; rows_of reads them."""
    spark = df.sparkSession
    packs = max(1, -(-rows // per_pack))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-packs // per_task))
    packs = max(packs, parts)
    blocks = df.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int").alias("pack")).mapInArrow(_blocks, "pack int, block binary")
    return blocks.repartition(parts, "pack"), packs, parts
