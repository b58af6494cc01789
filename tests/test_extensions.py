from __future__ import annotations

from pyspark.sql import functions as F

from marquetry.operators import catalogue, extensions
from marquetry.sources import sinks
from marquetry.sources.tables import one_per_id


def test_renamed_clones(spark):
    code = "total = price + 10\nresult = cost + 25\nresult = cost + 25\nprint('hello', x1)\nprint(\"other\", y)\nfor item in things:\nshort\n"
    df = spark.createDataFrame([(1, code), (2, None), (3, "")], "id int, code string")
    got = {r.id: (r.clone_lines, r.exact_lines) for r in extensions.renamed_clones(df, "id", "code").collect()}
    assert got == {1: (3, 1), 2: (0, 0), 3: (0, 0)}


def test_changes_and_ranks(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 7.5), ("b", 1, 1.0)], "u string, t int, v double")
    got = {(r.u, r.t): (r.previous, r.change) for r in extensions.changes(df, "u", ["t"], "v").collect()}
    assert got == {("a", 1): (None, None), ("a", 2): (5.0, None), ("a", 3): (None, None), ("b", 1): (None, None)}
    s = spark.createDataFrame([("x", i, n) for i, n in enumerate([5, 9, 9, 1])], "refactoring_type string, id int, n int")
    assert {r.id: r.impact_rank for r in extensions.ranked_by_impact(s, "n", 3).collect()} == {1: 1, 2: 1, 0: 3}


def test_lookups(spark):
    df = spark.createDataFrame([("1", "me", "x"), ("2", "you", "x"), ("3", None, None)], "id string, owner string, email string")
    assert [r.id for r in catalogue.by_key(df, "1", owner="me").collect()] == ["1"] and catalogue.by_key(df, "1", owner="you").collect() == []
    assert [r.id for r in catalogue.taken_by_others(df, "email", "x", "id", "1").collect()] == ["2"]
    assert catalogue.complete(df, "owner").count() == 2
    g = {r.owner: [x.id for x in r.rows] for r in catalogue.grouped_rows(df, "owner", ["id"]).collect()}
    assert g == {"me": ["1"], "you": ["2"], "Unassigned": ["3"]}
    assert one_per_id(df.unionByName(df)).count() == 3
    assert {r.id: r.n for r in catalogue.with_child_count(df, df.limit(0), "id", "owner", "n").collect()} == {"1": 0, "2": 0, "3": 0}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "id int, content string")
    sinks.append_table(df, f"{tmp_path}/t")
    sinks.append_table(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    sinks.replace_table(df, f"{tmp_path}/t")
    sinks.json_lines(df, f"{tmp_path}/j")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and spark.read.json(f"{tmp_path}/j").filter(F.col("content") == "a\nb").count() == 1
    sinks.text_parts(df, "content", f"{tmp_path}/x", "id")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/x").collect()) == ["", "a", "b"]
