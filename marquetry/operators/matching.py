"""Lookups that take the first match in list order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.functions import text as X


def first_lookup(left: DataFrame, right: DataFrame, on: str, order: str, prefix: str = "m_") -> DataFrame:
    """Left rows with the first right row (by `order`) of equal key; right columns carry the prefix; none: nulls.

    The right side is reduced to one row per key before the join (min_by, combined map-side), so a hot key costs one row.
    """
    cols = [c for c in right.columns if c != on]
    one = right.filter(F.col(on).isNotNull()).groupBy(F.col(on).alias("_k")).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return left.join(one, left[on] == F.col("_k"), "left").select(*[left[c] for c in left.columns], *[F.col(f"_r.{c}").alias(prefix + c) for c in cols])


def lookup_by_id_or_name(left: DataFrame, key: str, sections: DataFrame, order: str) -> DataFrame:
    """Left rows with the section whose id or name equals the key, first by order. Two equi-keys instead of an OR join."""
    keys = sections.select(F.explode(F.array_distinct(F.array("id", "name"))).alias("key_value"), F.col("id").alias("section_id"), F.col("name").alias("section_name"), F.col(order).alias("_o"))
    one = keys.filter("key_value is not null").groupBy("key_value").agg(F.min_by(F.struct("section_id", "section_name"), F.struct("_o", "section_id")).alias("s"))
    return left.join(one, left[key] == F.col("key_value"), "left").select(*[left[c] for c in left.columns], F.col("s.section_id").alias("matched_id"), F.col("s.section_name").alias("matched_name"))


#: Longest piece of a name that is a join key of its own; longer patterns are found by their first GRAM characters and verified.
GRAM = 6


def _pieces(c: Column) -> Column:
    """Different substrings of 1 to GRAM characters: at most GRAM times the length."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))
    return F.array_distinct(F.flatten(F.array(*[F.when(F.length(c) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)])))


def _containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(tid, pid) of texts (tid, t, g) that contain a pattern (pid, p, g) of the same group: an equi-join on the pattern's first
    GRAM characters, verified where the pattern is longer."""
    keyed = texts.select("tid", "t", F.col("g").alias("tg"), F.explode(_pieces(F.col("t"))).alias("k"))
    pat = patterns.select("pid", "p", F.col("g").alias("pg"), F.substring("p", 1, GRAM).alias("pk"))
    return keyed.join(pat, (F.col("k") == F.col("pk")) & (F.col("tg") == F.col("pg")) & ((F.length("p") <= GRAM) | F.contains("t", F.col("p")))).select("tid", "pid")


def match_files_to_people(files: DataFrame, people: DataFrame) -> DataFrame:
    """Files with the first person whose name contains the file's stem, whose first name the stem contains, or whose
    address's local part equals the stem without blanks; letter case does not count.

    files: file_id, file_name, and group_key (null: all people). people: person_id, name, email, group_key, pos.
    The rules compare lower-cased values and are equi-joins, never a nested loop over all pairs, on different values only: names,
    first names and local parts keep the first person of each, stems stand for all their files. A stem of up to GRAM characters
    meets the first person of each piece of a name; of longer patterns the join verifies those that begin alike.
    Files without a stem, and people without name and address, match nothing. Of equal positions the smaller person_id wins.
    """
    f = files.select("file_id", F.coalesce("group_key", F.lit("*")).alias("g"), F.lower(X.stem_words(F.coalesce("file_name", F.lit("")))).alias("stem"))
    p = people.select(F.struct("pos", "person_id").alias("who"), F.explode(F.array_distinct(F.array(F.col("group_key"), F.lit("*")))).alias("g"), F.lower(F.coalesce("name", F.lit(""))).alias("pname"), F.lower(X.local_part(F.coalesce("email", F.lit("")))).alias("local"))
    p = p.filter("g is not null").withColumn("first", X.first_word(F.col("pname")))
    first_of = lambda df, c: df.filter(F.length(c) > 0).groupBy("g", F.col(c).alias("v")).agg(F.min("who").alias("who"))
    names, firsts, locals_ = first_of(p, "pname"), first_of(p, "first"), first_of(p, "local")
    stems = f.filter(F.length("stem") > 0).select("g", "stem").distinct()
    short, long = stems.filter(F.length("stem") <= GRAM), stems.filter(F.length("stem") > GRAM)
    piece = names.select("g", "who", F.explode(_pieces(F.col("v"))).alias("stem")).groupBy("g", "stem").agg(F.min("who").alias("who"))
    hits = [short.join(piece, ["g", "stem"])]
    inside = _containing(names.select(F.col("who").alias("tid"), F.col("v").alias("t"), "g"), long.select(F.struct("g", "stem").alias("pid"), F.col("stem").alias("p"), "g"))
    hits.append(inside.select("pid.g", "pid.stem", F.col("tid").alias("who")))
    holds = _containing(stems.select(F.struct("g", "stem").alias("tid"), F.col("stem").alias("t"), "g"), firsts.select(F.col("who").alias("pid"), F.col("v").alias("p"), "g"))
    hits.append(holds.select("tid.g", "tid.stem", F.col("pid").alias("who")))
    hits.append(stems.withColumn("v", X.without_blanks(F.col("stem"))).join(locals_, ["g", "v"]).select("g", "stem", "who"))
    hit = reduce(DataFrame.unionByName, [h.select("g", "stem", "who") for h in hits]).groupBy("g", "stem").agg(F.min("who").alias("who"))
    found = f.join(hit, ["g", "stem"]).select("file_id", F.col("who.person_id").alias("person_id"))
    return files.join(found, "file_id", "left").select(*files.columns, "person_id")


def section_people(sections: DataFrame, members: str = "students") -> DataFrame:
    """The people of nested sections, flattened: section columns and one row per element of the array `members`, its fields as
    columns. Sections without members give no row."""
    rows = sections.select(*[c for c in sections.columns if c != members], F.explode(members).alias("_m"))
    return rows.select(*[c for c in rows.columns if c != "_m"], "_m.*")


def members_of(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows with at least one member (semi join)."""
    return df.join(members.select(key).distinct(), key, "left_semi")


def not_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows without a member (anti join); null keys have none and stay."""
    return df.join(members.select(key).distinct(), key, "left_anti")
