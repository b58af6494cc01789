from __future__ import annotations

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from marquetry.operators import activity, catalogue, dml, matching, similarity, validate
from marquetry.sources import files, jsoncols


def test_first_match_of_files(spark):
    f = spark.createDataFrame([(1, "ann_lee.py", None), (2, "work-of-bob.java", None), (3, "cjones.txt", None), (4, "nothing.py", None), (5, "", None), (6, "ann_lee.py", "s2")], "file_id int, file_name string, group_key string")
    p = spark.createDataFrame([("p1", "Ann Lee", "x@y", "s1", 1), ("p2", "Bob Ray", None, "s1", 2), ("p3", "Ann Leeds", "cjones@y", "s2", 3), ("p4", None, None, "s1", 4)], "person_id string, name string, email string, group_key string, pos int")
    got = {r.file_id: r.person_id for r in matching.match_files_to_people(f, p).collect()}
    assert got == {1: "p1", 2: "p2", 3: "p3", 4: None, 5: None, 6: "p3"}


def test_lookup_by_id_or_name(spark):
    left = spark.createDataFrame([("a",), ("B",), ("z",)], "k string")
    sec = spark.createDataFrame([("a", "B", 2), ("q", "a", 1)], "id string, name string, pos int")
    assert {r.k: r.matched_id for r in matching.lookup_by_id_or_name(left, "k", sec, "pos").collect()} == {"a": "q", "B": "a", "z": None}


def test_pairs_and_counts(spark):
    rows = [("s", "m1", 90.0), ("s", "m2", 80.0), ("s", "m3", 10.0), ("", None, None), (None, None, 50.0)]
    means = similarity.member_means(spark.createDataFrame(rows, "g string, m string, v double"), "g", "m", "v")
    assert {(r.grp, r.member): (r.mean_value, r.results) for r in means.collect()}[("Unassigned", "(none)")] == (25.0, 2)
    high = similarity.high_pairs(means).collect()
    assert [(r.member_a, r.member_b, r.similarity, r.status) for r in high] == [("m1", "m2", 85, "high")]
    assert {(r.grp, r.status): r.pairs for r in similarity.pair_status_counts(means).collect()} == {("s", "high"): 1, ("s", "medium"): 2}


def test_section_summary_counts_null_member_once(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, None), ("a", None, 4.0)], "s string, m string, v double")
    r = catalogue.section_summary(df, "s", "m", "v").collect()[0]
    assert (r.results, r.mean_value, r.members) == (3, 2, 2)


def test_pages_and_rolling_counts(spark):
    t = dt.datetime(2024, 1, 10)
    df = spark.createDataFrame([(i, i % 2, t - dt.timedelta(hours=12 * i)) for i in range(20)] + [(99, 0, None)], "id int, u int, ts timestamp_ntz")
    order = [F.col("ts").desc_nulls_last(), F.col("id")]
    assert [r.id for r in activity.page(df, order, 3, 2).collect()] == [2, 3, 4]
    assert activity.page(df, order, 3, 500).collect() == []
    p = activity.page_per_key(df, "u", order, 2, 1).collect()
    assert sorted((r.u, r.id, r.total) for r in p) == [(0, 2, 11), (0, 4, 11), (1, 3, 10), (1, 5, 10)]
    r = activity.rolling_counts(df, "ts", F.lit(t)).collect()[0]
    assert (r.total, r.this_week, r.today) == (21, 14, 2)


def test_dml_round_trip(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "a"), (4, "z")], "id int, v string")
    assert {r.id for r in dml.guarded_append(old, new, ["id", "v"]).collect()} == {1, 2, None, 4}
    assert {(r.id, r.v) for r in dml.upsert(old, new, "id").collect()} == {(1, "a"), (2, "x"), (3, "a"), (4, "z"), (None, "n")}
    assert {(r.id, r.v) for r in dml.update(old, F.col("id") == 1, v=F.lit("q")).collect()} == {(1, "q"), (2, "b"), (None, "n")}
    assert {r.id for r in dml.delete(old, F.col("id") == 1).collect()} == {2, None}
    assert {r.id for r in dml.cascade(old, "id", spark.createDataFrame([(2,)], "k int")).collect()} == {1, None}


def test_verdicts(spark):
    rows = [("def f():\n  pass", "python", None), ("class A {}", "java", None), (None, "python", "missing code"), ("x", None, "missing language"), ("   ", "python", "empty code"), ("x=1", "python", "code too short"), ("x = 1", "javascript", "unsupported language"), ("x = 1", " PYTHON", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, code string, language string, want string")
    for r in validate.with_verdicts(df, "code", "language").collect():
        assert r.strict_error == r.want
    got = df.select("i", validate.simple_syntax(F.col("code"), F.col("language")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, True, None, None, True, True, None, True]


def test_zip_and_json(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("d/a.py", "x = 1")
        z.writestr("B.JAVA", "class B {}")
        z.writestr("notes.md", "no")
    df = spark.createDataFrame([("ok.zip", bytearray(b.getvalue())), ("bad.zip", bytearray(b"zz")), ("none.zip", None)], "path string, content binary")
    got = files.zip_members(df).collect()
    assert {(r.archive, r.name, r.lang, r.error) for r in got} == {("ok.zip", "d/a.py", "python", None), ("ok.zip", "B.JAVA", "java", None), ("bad.zip", None, None, "BadZipFile"), ("none.zip", None, None, "BadZipFile")}
    (tmp_path / "x.py").write_text("a\nb\n")
    (tmp_path / "y.md").write_text("no")
    assert [(r.name, r.lang, r.content) for r in files.text_files(spark, str(tmp_path)).collect()] == [("x.py", "python", "a\nb\n")]
    j = spark.createDataFrame([('[{"from":"a","text":"t","ts":5}]',), ("broken",), (None,), ("",)], "j string")
    assert [r.item_text for r in jsoncols.exploded(j, "j", "messages").collect()] == ["t"]
