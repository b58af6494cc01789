"""File sources: whole text files, ZIP archives, and archive listings."""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted member extensions and the language each one stands for.
MEMBER_LANGUAGES = {"py": "python", "java": "java", "txt": "python"}
ZIP_SCHEMA = "archive string, name string, ext string, lang string, content string, error string"


def extension(name: Column) -> Column:
    """Lower-cased part after the last dot; the whole name where there is no dot; null stays null."""
    return F.lower(F.element_at(F.split(name, r"\.", -1), -1))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per .py/.java/.txt file: name, ext, lang, content."""
    raw = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    named = raw.select(F.element_at(F.split(F.input_file_name(), "/", -1), -1).alias("name"), F.col("value").alias("content"))
    lang = F.coalesce(*[F.when(F.col("ext") == k, v) for k, v in MEMBER_LANGUAGES.items()])
    return named.withColumn("ext", extension(F.col("name"))).filter(F.col("ext").isin(*MEMBER_LANGUAGES)).withColumn("lang", lang)


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "name", "ext", "lang", "content", "error"]
    for batch in batches:
        for path, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[tuple] = []
            try:
                with zipfile.ZipFile(io.BytesIO(blob or b"")) as z:
                    for item in z.infolist():
                        ext = item.filename.rsplit(".", 1)[-1].lower()
                        if not item.is_dir() and ext in MEMBER_LANGUAGES:
                            rows.append((path, item.filename, ext, MEMBER_LANGUAGES[ext], z.read(item).decode("utf-8", "replace"), None))
            except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, EOFError, RuntimeError, ValueError, OSError) as e:
                rows.append((path, None, None, None, None, type(e).__name__))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)


def zip_members(archives: DataFrame) -> DataFrame:
    """Members of ZIP archives given as (path, content binary): directories and other extensions are skipped.

    A broken, empty or null archive gives one row with `error` set and no name, behind the members that could still be read.
    """
    return archives.select("path", "content").mapInArrow(_unzip, ZIP_SCHEMA)


def zip_listing(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of stored archives without reading their content (column pruning of the binary source)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return df.select(F.element_at(F.split("path", "/", -1), -1).alias("name"), F.col("length").alias("size"), F.lit("zip").alias("file_type"))
