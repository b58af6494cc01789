"""Queries of the subpackage. Each runs over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquetry.functions.text import trimmed
from marquetry.llm import copies, history, mixing, names, quality
from marquetry.llm import near_duplicates as near
from marquetry.llm import records as rec
from marquetry.llm import shared_spans as spans
from marquetry.llm import syntax, tokenize


def _records(spark, d):
    return rec.records(spark, d), rec.row_count(spark, d, "analyses", "uploaded_files")


def p1_found(spark, d):
    return spans.shared_spans(*_records(spark, d))


def p1_shared_part(spark, d):
    df, n = _records(spark, d)
    return spans.shared_part(spans.shared_spans(df, n), df)


def _sources(spark, d):
    a = spark.read.parquet(f"{d}/analyses.parquet").select("id", F.col("user_id").alias("owner"), F.col("language").alias("declared"), F.col("code").alias("text"))
    u = spark.read.parquet(f"{d}/uploaded_files.parquet").select("id", F.col("user_id").alias("owner"), F.col("file_type").alias("declared"), F.col("content").alias("text"))
    return a.unionByName(u)


def p3_found(spark, d):
    return syntax.verdicts(_sources(spark, d)).filter(~F.col("valid")).select("record_id")


def p3_rates(spark, d):
    v = syntax.verdicts(_sources(spark, d)).withColumn("owner", F.nullif(F.lower(trimmed(F.col("owner"))), F.lit("")))
    return syntax.rates(v)


def p4_found(spark, d):
    return copies.same_text_pairs(rec.records(spark, d))


def p4_copies(spark, d):
    return copies.collapsed(rec.records(spark, d))


def _code_records(spark, d):
    return rec.records(spark, d).filter(F.col("kind") != rec.TEXT_KIND), rec.row_count(spark, d, "analyses", "uploaded_files")


def p6_found(spark, d):
    return near.near_pairs(*_code_records(spark, d))


def p6_groups(spark, d):
    return near.near_groups(*_code_records(spark, d))


def p8_ids(spark, d):
    return tokenize.encoded(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), ["doc_id"], "text")


def _mix(spark, d, tempered=False):
    return mixing.Mix(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source"), spark.read.parquet(f"{d}/mix_targets.parquet"), tempered=tempered)


def p9_mix(spark, d):
    return _mix(spark, d).chosen()


def p9_shares(spark, d):
    return _mix(spark, d).shares()


def p9_tempered(spark, d):
    return _mix(spark, d, tempered=True).chosen()


def p9_tempered_shares(spark, d):
    return _mix(spark, d, tempered=True).shares()


def _quality(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    return quality.judged(t("documents").select("doc_id", "text"), t("common_words"), t("doc_labels"))


def p10_found(spark, d):
    return _quality(spark, d).filter(F.col("class").isin("list", "table", "junk")).select("doc_id")


def p10_stats(spark, d):
    return quality.as_columns(_quality(spark, d))


def _entries(spark, d):
    s = spark.read.parquet(f"{d}/students.parquet").select("id", "name", "email")
    return s.unionByName(spark.read.parquet(f"{d}/users.parquet").select("id", F.col("full_name").alias("name"), "email")), spark.read.parquet(f"{d}/nicknames.parquet")


def p7_found(spark, d):
    return names.variant_pairs(*_entries(spark, d))


def p7_people(spark, d):
    return names.people(*_entries(spark, d)).select("id", "family", "person")


def p5_found(spark, d):
    return history.seen_before(rec.records(spark, d, uploads_only=True))
