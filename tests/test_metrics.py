from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquetry.functions import labels as L
from marquetry.functions import text as X
from marquetry.operators import clones, metrics

BASKET = "total = 0\n\nfor item in basket:\n\tif item.price > 10 and item.qty:\n\t\ttotal = total + item.price\n\nfor item in basket:\n\ttotal = total + item.price\n"


def measured(spark, *rows):
    df = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(rows)], "id int, code string, language string, _x string")
    return [r.asDict() for r in metrics.document_metrics(df, "code", F.col("language")).orderBy("id").collect()]


def test_golden_cases(spark):
    empty, two, basket, none = measured(spark, ("", "python"), ("x=1\r\ny=2\r\n", "java"), (BASKET, "python"), (None, None))
    pick = lambda r: tuple(r[c] for c in ("lines_of_code", "total_lines", "duplicate_lines", "clone_percentage", "cyclomatic_complexity", "maintainability_index"))
    assert pick(empty) == (1, 0, 0, 0.0, 1, 98)
    assert pick(none) == pick(empty)
    assert pick(two) == (2, 2, 0, 0.0, 1, 98)
    assert pick(basket) == (8, 6, 2, 33.3, 7, 69)


def test_clone_pairs_and_suggestions(spark):
    df = spark.createDataFrame([(1, BASKET), (2, None), (3, "")], "id int, code string")
    assert [(r.first_line, r.repeat_line) for r in clones.clone_pairs(df, "id", "code").orderBy("pair_no").collect()] == [(2, 5), (4, 6)]
    s = metrics.suggestions(metrics.document_metrics(df, "code")).collect()
    assert [(r.id, r.refactoring_type) for r in s] == [(1, "Extract Method")]
    nested = clones.clone_structs(df, "id", "code").collect()[0]
    assert nested.clones[0].locations[0].start_line == 2 and nested.clones[0].clone_type == 1


def test_metrics_need_no_exchange(spark):
    df = spark.createDataFrame([(1, BASKET)], "id int, code string")
    plan = metrics.document_metrics(df, "code")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize(
    "scale,cases",
    [
        ("clone", {25.0: "low", 25.1: "medium", 50.0: "medium", 50.1: "high"}),
        ("complexity", {10.0: "low", 11.0: "medium", 20.0: "medium", 21.0: "high"}),
        ("maintainability", {29.0: "low", 30.0: "medium", 59.0: "medium", 60.0: "good"}),
        ("badge", {40.0: "green", 41.0: "orange", 70.0: "orange", 71.0: "red"}),
        ("section", {15.0: "low", 16.0: "medium", 30.0: "medium", 31.0: "high"}),
    ],
)
def test_class_boundaries(spark, scale, cases):
    rows = spark.createDataFrame([(k,) for k in cases], "v double").select("v", L.klass(F.col("v"), scale).alias("c")).collect()
    assert {r.v: r.c for r in rows} == cases


def test_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).collect()[0].c
    assert [one(L.size_label(F.lit(n))) for n in (1023, 1024, 1048575, 1048576)] == ["1023 B", "1.0 KB", "1024.0 KB", "1.0 MB"]
    at = lambda s: one(L.age_label(F.expr(f"timestamp_ntz'2024-06-01 00:00:00' - interval {s} seconds"), F.expr("timestamp_ntz'2024-06-01 00:00:00'")))
    assert [at(s) for s in (59, 60, 120, 3600, 86399, 86400, 172800, 604800, 1209600)] == [
        "Just now", "1 minute ago", "2 minutes ago", "1 hour ago", "23 hours ago", "Yesterday", "2 days ago", "1 week ago", "2 weeks ago",
    ]
    assert one(X.shortened(F.lit("x" * 36))) == "x" * 36 and one(X.shortened(F.lit("x" * 37))) == "x" * 36 + "..."
    assert one(X.html_escaped(F.lit("<a&b>"))) == "&lt;a&amp;b&gt;"
    assert one(X.url_component(F.lit("a b"))) == "a%20b" and one(X.from_url_component(F.lit("a%20b+"))) == "a b+"
    assert one(X.stem_words(F.lit("dir/ann_lee-1.PY"))) == "ann lee 1"
    assert one(X.falsy_to(F.lit(""), "d")) == "d" and one(X.shown(F.lit(None).cast("int"))) == "-"
    assert one(X.first_lines(F.lit("1\n2\n3\n4\n5\n6"))) == "1\n2\n3\n4\n5" and one(X.first_lines(F.lit(""))) is None
    assert one(X.repeated_lines(F.lit("s"), F.lit(9))) == "s\ns\ns\ns\ns"
    assert one(F.size(metrics.string_literals(F.lit("""a = 'x' + "y'z" """)))) == 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\r\n\x0b\x85x=", max_size=30), min_size=1, max_size=8))
def test_line_counts_follow_splitlines(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.line_count(F.col("t")).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: max(1, len(t.splitlines())) for i, t in enumerate(texts)}
