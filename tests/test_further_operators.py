from __future__ import annotations

import ast
import datetime as dt
import io
import itertools
import random
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquetry.functions import labels as L
from marquetry.functions import text as X
from marquetry.functions.syntax import python_parses
from marquetry.operators import activity, catalogue, dml, extensions, matching, metrics, similarity, validate
from marquetry.plans.queries import QUERIES
from marquetry.sources import files, jsoncols, sinks
from marquetry.sources.tables import file_bytes, one_per_id, spread
from marquetry.streaming import feed

SF = "/root/testdata/sf0.001"


def one(spark, c):
    return spark.range(1).select(c.alias("c")).collect()[0].c


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="a\\\"'\n ", max_size=25), min_size=1, max_size=30))
def test_string_literals_equal_the_back_reference_form(spark, texts):
    plain = re.compile(r"(\"\"\"|'''|\"|')(?:\\.|(?!\1)[\s\S])*?\1")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", metrics.string_literals(F.col("t")).alias("found"))
    assert {r.i: r.found for r in df.collect()} == {i: [m[0] for m in plain.finditer(t)] for i, t in enumerate(texts)}


def test_string_literals_of_any_length(spark):
    long = '"' + 'a\\"' * 200_000 + '"'
    df = spark.createDataFrame([(long,), ('"""' + "x\n" * 200_000 + '"""',), ("'" + "\\" * 300_001,)], "t string")
    assert sorted(len(r.f) for r in df.select(metrics.string_literals(F.col("t")).alias("f")).collect()) == [0, 1, 1]


def test_every_other_language_is_measured_like_java(spark):
    df = spark.createDataFrame([("1", "python", "# a\nif x and y\nprint"), ("2", "c", "// a\nif x && y\nString"), ("3", None, "// a\nif x && y\nString"), ("4", " Java ", "// a\nif x && y\nString")], "id string, language string, code string")
    got = {r.id: (r.cyclomatic_complexity, r.keywords, r.comment_lines) for r in metrics.token_counts(metrics.document_metrics(df, "code", F.col("language")), "code", F.col("language")).collect()}
    assert got == {"1": (3, 3, 1), "2": (3, 2, 1), "3": (3, 2, 1), "4": (3, 2, 1)}


def test_totals(spark):
    df = spark.createDataFrame([("a", 3, 10.0), ("a", None, None), (None, 4, 3.5)], "kind string, size int, v double")
    assert tuple(catalogue.totals(df, "size", "kind").collect()[0]) == (3, 7, 1)
    assert tuple(catalogue.totals(df.limit(0), "size", "kind").collect()[0]) == (0, 0, 0)
    assert catalogue.overall_mean(df, "v", "m").collect()[0].m == 5 and catalogue.overall_mean(df.limit(0), "v", "m").collect()[0].m == 0
    nested = spark.createDataFrame([("s", [1, 2]), ("t", []), ("u", None)], "id string, xs array<int>")
    assert tuple(catalogue.total_children(nested, "xs").collect()[0]) == (3, 2)


def test_gates(spark):
    u = spark.createDataFrame([("1", "admin"), ("2", "student"), (None, None)], "id string, role string")
    seen = lambda me, *roles: sorted(r.id for r in catalogue.allowed(catalogue.others(u, "id", F.lit(me)), u, F.lit(me), roles).collect())
    assert seen("1", "admin") == ["2"] and seen("2", "admin") == [] and seen("9", "admin") == [] and seen("2", "student") == ["1"]
    assert [r.id for r in catalogue.first_by(u.na.drop(), "id", 1).collect()] == ["1"]


def test_owned_delete_and_prepend(spark):
    t = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None), (None, "a")], "id string, owner string")
    asked = spark.createDataFrame([("1", "b"), ("2", "b"), ("3", None), (None, "a")], "id string, owner string")
    assert sorted(str(r.id) for r in dml.delete_owned(t, asked, "id", "owner").collect()) == ["1", "3", "None"]
    rows = dml.prepend(dml.prepend(t, t.limit(1), "at", 1), t.limit(1), "at", 2)
    assert sorted(r["at"] for r in rows.collect()) == [0, 0, 0, 0, 1, 2]


def test_descriptions_and_labels(spark):
    assert one(spark, activity.described("code", F.lit("java"), X.number_text(F.lit(40.0)))) == "Analyzed java code - 40% clone detected"
    assert one(spark, activity.described("batch", F.lit("a.zip"), F.lit("3"), activity.in_section(F.lit("S")))) == "Uploaded batch: a.zip - 3 files extracted (Section: S)"
    assert one(spark, activity.described("code", F.lit(None).cast("string"), F.lit("1"))) is None
    at = F.expr("timestamp_ntz'2024-03-05 14:07:00'")
    assert [one(spark, L.day_label(at, p)) for p in L.DATE_PATTERNS] == ["Mar 5, 2024", "March 5, 2024", "Mar 5, 02:07 PM"]
    assert one(spark, L.iso_label(at)) == "2024-03-05T14:07:00" and one(spark, L.iso_label(at + F.expr("interval 5 microseconds"))) == "2024-03-05T14:07:00.000005"
    assert one(spark, L.iso_label(F.lit(None).cast("timestamp_ntz"))) is None
    assert [one(spark, X.is_hex_colour(F.lit(c))) for c in ("#aB09fF", " #aB09fF\n", "#aB09f", "#aB09fG", "aB09fF")] == [True, True, False, False, False]
    assert [one(spark, L.kind_label(F.lit(k))) for k in ("zip", "java", "python", "text", "x")] == ["ZIP", "Java", "Python", "Text", "File"]
    assert [one(spark, L.kind_icon(F.lit(k))) for k in ("zip", "java", "python", "text", "x")] == ["ZIP", "JV", "PY", "TXT", "F"]
    assert [one(spark, validate.status_code(F.lit(k))) for k in ("validation", "analysis", "odd", None)] == [400, 500, 500, None]
    assert [one(spark, X.plural(F.lit(n))) for n in (0, 1, 2)] == ["s", "", "s"]


def test_parser_limits_are_no_errors():
    assert python_parses("x = " + "+".join(["1"] * 20_000)) is True
    assert python_parses("if a:\n pass\n" + "elif b:\n pass\n" * 8_000) is None
    assert python_parses("(" * 250 + "1" + ")" * 250) is None
    assert python_parses("def f():\n nonlocal x\n") is True and python_parses("x = (") is False and python_parses("x\0") is False


def test_simple_syntax_on_the_whole_table(spark):
    duckdb = pytest.importorskip("duckdb")

    def parses(code, language):
        language = (language or "").strip().lower()
        if language != "python" or code is None:
            return True if language == "java" else None
        try:
            ast.parse(code)
            return True
        except SyntaxError:
            return False

    rows = duckdb.sql(f"select distinct id, language, code from '{SF}/analyses.parquet'").fetchall()
    assert {r.id: r.parses for r in QUERIES["q32_simple_syntax"](spark, SF).collect()} == {i: parses(c, x) for i, x, c in rows}


def test_high_pairs_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(g, f"m{i}", r.choice([r.randint(0, 1000) / 10, 40.5, 41.0])) for g, n in (("a", 60), ("b", 25), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "grp string, member string, mean_value double")
    for above in (40, 70, 90):
        want = {(g, a, b) for (g, a, v), (h, b, w) in itertools.product(rows, rows) if g == h and a < b and max(5, min(95, int((v + w) / 2 + 0.5))) > above}
        got = similarity.high_pairs(df, above)
        assert {(x.grp, x.member_a, x.member_b) for x in got.collect()} == want


def test_matching_equals_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
    people = [(f"p{i:03}", r.choice([None, "", f"{word()} {word()}", word()]), r.choice([None, f"{word()}@x", "@y"]), r.choice(["s1", "s2", None]), r.randint(0, 5)) for i in range(80)]
    names = [(i, r.choice([f"{word()}_{word()}.py", f"{word()}.txt", f"d/{word()}-{word()}.java", "", None, f"{word()}"]), r.choice([None, "s1", "s2", "s9"])) for i in range(150)]

    def match(name, group):
        stem = re.sub(r"(?i)\.(py|java|txt)$", "", (name or "").split("/")[-1]).lower().replace("_", " ").replace("-", " ")
        for _, i, n, local in sorted((p[4], p[0], (p[1] or "").lower(), (p[2] or "").split("@")[0].lower()) for p in people if group is None or p[3] == group):
            first = n.split(" ")[0]
            if stem and ((n and stem in n) or (first and first in stem) or (local and local == stem.replace(" ", ""))):
                return i
        return None

    f = spark.createDataFrame(names, "file_id int, file_name string, group_key string")
    p = spark.createDataFrame(people, "person_id string, name string, email string, group_key string, pos int")
    assert {x.file_id: x.person_id for x in matching.match_files_to_people(f, p).collect()} == {i: match(n, g) for i, n, g in names}
    nested = spark.createDataFrame([("s", [("a", "e")]), ("t", []), ("u", None)], "id string, students array<struct<name:string,email:string>>")
    assert [tuple(x) for x in matching.section_people(nested).collect()] == [("s", "a", "e")]


def test_repeats_keep_the_least_row(spark):
    df = spark.createDataFrame([("1", "b", 2), ("1", "a", 9), ("2", None, 1), (None, "z", 1), (None, "y", 1)], "id string, v string, n int")
    assert sorted(map(str, (tuple(r) for r in one_per_id(df).collect()))) == ["('1', 'a', 9)", "('2', None, 1)", "(None, 'y', 1)"]


def test_damaged_archives_and_listing(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.py", "x = 1\n" * 500)
        z.writestr("b.py", "y = 2\n" * 500)
    whole = b.getvalue()
    broken = [whole[:i] + bytes([whole[i] ^ 0xFF]) + whole[i + 1 :] for i in range(len(whole))]
    df = spark.createDataFrame([(str(i), bytearray(x)) for i, x in enumerate([whole, *broken])], "path string, content binary")
    rows = files.zip_members(df).collect()
    assert {r.archive for r in rows} <= {str(i) for i in range(len(broken) + 1)} and any(r.error == "error" for r in rows)
    assert sorted(r.name for r in rows if r.archive == "0") == ["a.py", "b.py"]
    (tmp_path / "one.zip").write_bytes(whole)
    (tmp_path / "two.py").write_text("x")
    assert [tuple(r) for r in files.zip_listing(spark, str(tmp_path)).collect()] == [("one.zip", len(whole), "zip")]
    assert one(spark, L.file_kind(files.extension(F.lit("A.ZIP")))) == "zip" and one(spark, L.file_kind(files.extension(F.lit("noext")))) == "text"


def test_replacing_a_table_keeps_the_old_one_until_the_end(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(5), path)
    sinks.replace_table(spark.read.parquet(path).filter("id > 1"), path)
    assert spark.read.parquet(path).count() == 3
    bad = spark.read.parquet(path).withColumn("x", F.expr("raise_error('no')"))
    with pytest.raises(Exception, match="no"):
        sinks.replace_table(bad, path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_json(spark):
    df = spark.createDataFrame([("1", None)], "id string, name string")
    assert df.select(jsoncols.as_json("id", "name").alias("j")).collect()[0].j == '{"id":"1","name":null}'
    xs = spark.createDataFrame([([1, 2, None],), (None,)], "xs array<int>")
    assert [r.y for r in xs.select(dml.update_in_array("xs", lambda x: x == 2, lambda x: x * 10).alias("y")).collect()] == [[1, 20, None], None]


def test_late_rows_of_a_stream_are_dropped_under_a_watermark(spark, tmp_path):
    src, day = tmp_path / "e", lambda n: dt.datetime(2024, 1, n, 12)
    schema = "id int, ts timestamp_ntz, event_type string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    write([(1, day(1), "view")])
    kind = spark.createDataFrame([], schema).schema

    def step():
        stream = feed.daily_counts(feed.event_stream(spark, str(src), kind), "ts", "event_type", late="2 days")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return [(str(r.day), r.n) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "o")).collect()]

    step()
    write([(2, day(20), "view")])
    assert ("2024-01-01", 1) in step()  # the watermark is at the 18th, which closes the first day
    write([(3, day(1), "view"), (4, day(25), "view")])
    step()
    assert [n for d, n in step() if d == "2024-01-01"] == [1]


def test_renamed_clones_of_equal_rows(spark):
    df = spark.createDataFrame([("1", "total = price + 1\n" * 2)] * 2, "id string, code string")
    assert [(r.clone_lines, r.exact_lines) for r in one_per_id(extensions.renamed_clones(df, "id", "code")).collect()] == [(1, 1)]


def test_only_small_tables_are_spread(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda size: spread(df, "id", size)._jdf.queryExecution().executedPlan().toString()
    assert 0 < file_bytes(df) < 1 << 20 and "Exchange" in plan(file_bytes(df)) and "Exchange" not in plan(1 << 40)
    assert spread(df, "id", 0).count() == 100
