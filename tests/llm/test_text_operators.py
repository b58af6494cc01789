from __future__ import annotations

import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquetry.llm import components, mixing, names, quality, syntax, tokenize
from marquetry.llm.java_grammar import java_parses

# Java 17 sources and whether they are valid syntax.
JAVA = [
    ("", True), ("class A {}", True), ("class A {", False), ("class A {}}", False), ("record P(int x, int... y) implements I { P { x = 1; } static int z; }", True), ("record P(int x) { int f() { return x } }", False),
    ("sealed interface S permits A, B {} non-sealed class A implements S {}", True), ("enum E { A(1) { void f() {} }, B; int x; E() {} }", True), ("@interface N { int value() default 3; String[] s() default {}; }", True),
    ("class A { int f(int k) { return switch (k) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new X(); }; } }", True), ("class A { void f() { switch (k) { case 1: x(); break; default: } } }", True),
    ("class A { void f() { switch (k) { case 1: x(); case 2 -> y(); } } }", False), ("class A { String s = \"\"\"\n  hi \"there\" \\\n  \"\"\"; }", True), ("class A { String s = \"open; }", False), ("class A { char c = '\\u0041', d = '\\''; }", True),
    ("class A { void f(Object o) { if (o instanceof String s && s.length() > 1) g(s); } }", True), ("class A { <T extends B & C> List<? super T> f(Map<String, List<int[]>> m) throws E, F { return (List<? super T>) m.<T>get(1)[2]; } }", True),
    ("class A { Runnable r = () -> {}, q = x -> x + 1, p = (int a, final var b) -> a; F f = A::new, g = int[]::new, h = this.<T>m()::k, l = List<String>::size; }", True),
    ("class A { void f() { try (var a = b; c) { } catch (X | Y e) { } finally { } } }", True), ("class A { void f() { try { } } }", False), ("class A { void f() { x + 1; } }", False), ("class A { void f() { if (a) int x = 1; } }", False),
    ("class A { void f() { for (int i = 0, j; i < n; i++, --j) ; for (final var x : xs) { continue; } for (;;) break; l: do { } while (a); } }", True), ("class A { int[] a = {1, 2,}, b[] = new int[3][]; Object o = new int[]{1}.length; }", True),
    ("class A { int a = b >> 2 >>> 3 << 1, c = -d++ + ~e * (int) f - (g), h = (A) (x), i = a > b ? c : d -> e; }", True), ("class A { int a = b > > 2; }", False), ("package a.b; import static c.D.*; import e.F; class G {}", True), ("import a.b;\npackage c;", False),
    ("class A { void f() { int yield = 1; record R(int a) {} var record = 2; enum E { X } } }", True), ("class A { int _ = 1; }", False), ("<<<<<<< HEAD\nclass A {}\n=======", False), ("class A { void f(A this, int... x, int y) {} }", False), ("class A { int x = 0x1F_FFL, y = 1e3, z = 0b1_0; double d = .5f; }", True),
    ("module a.b { requires transitive c; exports d to e, f; }", True), ("class A { @B(c = {1, 2}, d = @E) @F(3) int g; Object h = new @I J<>() { { k(); } static { } }; }", True), ("class A { void f() { assert a : b; synchronized (c) { } throw d; } int g()[] { return null; } }", True), ("class A { void f() { else { } } }", False),
]


@pytest.mark.parametrize("text,valid", JAVA)
def test_java_grammar(text, valid):
    assert java_parses(text) is valid
    assert java_parses(text) is valid  # again, from remembered shapes


def test_verdicts(spark):
    rows = [("1", "Python ", "def f():\n    return 1\n"), ("2", "python", "class A { int x; }"), ("3", "java", "print('x')\n"), ("4", "java", "class A {"), ("5", "text", "("), ("6", None, "x"), ("7", "python", None), ("8", "java", "  "), (None, "java", "{"), ("4", "java", "class A {"), ("9", "python", "def f():\n  pass\n<<<<<<< HEAD\n"), ("10", "python", "return 1"), ("11", "python", "﻿x = 1\r\ny = f'{x!r:>{3}}'")]
    df = spark.createDataFrame([(i, "o", d, t, 1) for i, d, t in rows], "id string, owner string, declared string, text string, valid int")
    v = syntax.verdicts(df)
    got = {r.record_id: (r.verdict, r.parses_as) for r in v.collect()}
    assert got == {"1": ("ok", "python"), "2": ("wrong_extension", "java"), "3": ("wrong_extension", "python"), "4": ("corrupt", None), "9": ("corrupt", None), "10": ("ok", "python"), "11": ("ok", "python")}
    r = {r.language: (r.files, r.invalid, r.wrong_extension, r.corrupt, r.invalid_percent) for r in syntax.rates(v).collect()}
    assert r == {"python": (5, 2, 1, 1, 40.0), "java": (2, 2, 1, 1, 100.0)}
    assert syntax.verdicts(df.limit(0)).collect() == []


DEEP = "class A {{ void f() {{ {} }} int g = {}; }}"


@pytest.mark.parametrize("n", [200, 1000, 5000])
def test_nesting_is_no_error(n):
    for statement, value in (("", "(" * n + "1" + ")" * n), ("{" * n + "}" * n, "1"), ("", "a ? b : " * n + "c"), ("if (a) " * n + "c();", "1"), ("", "f(" * n + "1" + ")" * n), ("", "a -> " * n + "c")):
        assert java_parses(DEEP.format(statement, value))
    assert not java_parses(DEEP.format("", "(" * n + "1 +" + ")" * n))
    limit = sys.getrecursionlimit()
    assert limit < 100_000  # put back


def test_limits_of_the_parser_are_no_errors(spark):
    sum_ = "x = " + "+".join(["1"] * 20_000)
    chain = "if a:\n pass\n" + "elif b:\n pass\n" * 8_000
    nested = "x = " + "(" * 250 + "1" + ")" * 250
    df = spark.createDataFrame([("1", "python", sum_), ("2", "python", chain), ("3", "python", nested), ("4", "python", sum_ + "+"), ("5", "java", "// x\n"), ("6", "java", chain)], "id string, declared string, text string").selectExpr("*", "'o' as owner")
    got = {r.record_id: (r.valid, r.verdict, r.parses_as, r.also_parses_as) for r in syntax.verdicts(df).collect()}
    assert got == {"1": (True, "ok", "python", None), "2": (None, "undecided", None, None), "3": (None, "undecided", None, None), "4": (False, "corrupt", None, None), "5": (True, "ok", "java", None), "6": (False, "undecided", None, None)}
    r = {r.language: (r.files, r.invalid, r.undecided) for r in syntax.rates(syntax.verdicts(df)).collect()}
    assert r == {"python": (4, 1, 2), "java": (2, 1, 1)}
    both = syntax.judge("", "python")
    assert both == (True, "ok", "python", "java")


PATH = f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}"


@pytest.fixture(scope="module")
def both():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return tokenize.Replay(PATH), t


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80) | st.text(alphabet="ab 'sdé\r\n\t0１<|endoftext|>", max_size=120))
def test_replay_equals_library(both, text):
    mine, library = both
    assert mine.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_encoding(spark, both):
    long = "a" * 30_000 + " b" * 10_000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x <|endoftext|>", 0), (4, long, 0), (4, "x", 0)], "doc_id bigint, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in tokenize.encoded(df, ["doc_id"], "text").collect()]
    want = [(1, []), (2, []), *[(k, both[1].encode(t, add_special_tokens=False).ids) for k, t in ((3, "x <|endoftext|>"), (4, long), (4, "x"))]]
    assert sorted(got) == sorted(want)
    assert {(r.doc_id, r.tokens) for r in tokenize.token_counts(df, ["doc_id"], "text").collect()} == {(k, len(v)) for k, v in want}
    assert tokenize.encoded(df.limit(0), ["doc_id"], "text").collect() == []


def test_cache_is_bounded(both, monkeypatch):
    monkeypatch.setattr(tokenize, "CACHE_WORDS", 5)
    r = tokenize.Replay(PATH)
    for text in ("one two three four five six seven", "eight nine ten", "one two"):
        assert r.encode([text])[0] == both[1].encode(text, add_special_tokens=False).ids


def test_target_weights():
    s = [mixing.Source("a", 0.5, 1, 1000, 10), mixing.Source("b", 0.3, 2, 90, 3), mixing.Source("c", 0.2, 3, 0, 0), mixing.Source("d", 0.0, 3, 50, 2)]
    x, total, w = mixing.target_weights(s)
    assert x == 1.0 and abs(total - 180 * 0.8 / 0.3) < 1e-9 and abs(w["a"] - 0.625) < 1e-9 and w["c"] == w["d"] == 0
    x, total, w = mixing.target_weights(s, 900)
    assert 0 < x < 1 and abs(w["b"] * total - 180) < 1e-3 and abs(sum(w.values()) - 1) < 1e-9
    x, total, w = mixing.target_weights(s, 1e9)
    assert total == 1180 and abs(w["a"] - 1000 / 1180) < 1e-9
    assert mixing.target_weights([]) == (1.0, 0.0, {})
    e, t = mixing.tempered([0.7, 0.2, 0.1], 1.0)
    assert abs(mixing.entropy(t) - 1.0) < 1e-6 and 0 < e < 1


def test_mixture(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["tree", "house", "a", "of"]) for _ in range(r.randint(1, 60))), r.choice(["big", " BIG", "mid", "small" if i % 9 == 0 else "big", "other"])) for i in range(900)]
    docs += [(1000, None, "big"), (1001, "  ", "mid"), (1002, "text", None), (1003, "text", " ")]
    targets = spark.createDataFrame([("Big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.2, 3), ("absent", 0.1, 9), (None, 0.4, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), targets, block=20)
    got = m.chosen().collect()
    most = {"big": 1, "mid": 2, "small": 3}
    assert len({x.doc_id for x in got}) == len(got) and all(1 <= x.repeats <= most[x.source] for x in got)
    shares = {x.source: x for x in m.shares().collect()}
    assert all(abs(shares[k].actual_share - v / 0.9) < 0.004 for k, v in {"big": 0.5, "mid": 0.2, "small": 0.2}.items()) and shares["absent"].actual_share == 0
    empty = mixing.Mix(spark.createDataFrame([], "doc_id bigint, text string, source string"), targets)
    assert empty.chosen().collect() == [] and empty.shares().count() == 4


def test_tempered_weights():
    s = [mixing.Source("a", 0.5, 3, 1000, 10), mixing.Source("b", 0.3, 3, 90, 3), mixing.Source("c", 0.2, 3, 0, 0), mixing.Source("d", 0.0, 3, 50, 2)]
    h = mixing.entropy([0.625, 0.375])
    x, total, w = mixing.tempered_weights(s, 500)
    assert 0 < x < 1 and total == 500 and abs(mixing.entropy(list(w.values())) - h) < 1e-6 and abs(w["a"] / w["b"] - (1000 / 90) ** x) < 1e-6
    near, total, w = mixing.tempered_weights(s, 1090)  # b can't be repeated as often as that entropy asks
    assert x < near < 1 and abs(w["b"] * total - 270) < 1e-3
    assert mixing.tempered_weights(s, 1e9)[1] == 3270 and mixing.tempered_weights([], 5) == (1.0, 0.0, {})
    peaked = [mixing.Source("a", 0.99, 2, 100, 1), mixing.Source("b", 0.01, 2, 90, 1)]
    x, _, w = mixing.tempered_weights(peaked, 100)
    assert x > 1 and abs(w["a"] * 100 - min(200, 99)) < 1


@pytest.mark.parametrize("tempered,block", [(False, 1), (True, 1), (True, 20)])
def test_mixtures_meet_their_weights(spark, tempered, block):
    r = random.Random(6)
    docs = [(i, " ".join(r.choice(["tree", "house"]) for _ in range(r.randint(1, 9))), r.choice(["a", "a", "a", "b", "c" if i % 5 == 0 else "a"])) for i in range(1500)]
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.3, 4)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), targets, block=block, tempered=tempered)
    got = m.chosen().collect()
    most = {"a": 1, "b": 2, "c": 4}
    assert len({x.doc_id for x in got}) == len(got) and all(1 <= x.repeats <= most[x.source] for x in got)
    used = {s: sum(x.tokens * x.repeats for x in got if x.source == s) for s in most}
    for s in most:
        assert abs(used[s] - m.total * m.weights[s]) <= 9, s  # within one document
    shares = {x.source: x.actual_share for x in m.shares().collect()}
    assert all(abs(shares[s] - m.weights[s]) < 0.01 for s in most)


PEOPLE = [
    ("1", "Kilor K. Barenurfleheim", "kilor.barenurfleheim@campus.example"), ("2", "Barenurfleheim, Kilor", ""), ("3", "kilro barenurfleheim (late)", "kbarenurfleheim7@mail.example"), ("4", "Kery Barenurfleheim", "kerkel.barenurfleheim@x.example"), ("5", "K. Barenurfleheim", "none@campus.example"),
    ("6", "Dr. Kily Barénurfleeheim", "s00ab@campus.example"), ("7", "K. Barenurfleheim", "kerkel.barenurfleheim@x.example"), ("8", "Masolmane Firmalelbalmore", "-"), ("9", "M. FIRMALELBALMORE", None), ("10", None, "a@b"), ("11", " ", "a@b"), (None, "Kilor Barenurfleheim", ""), ("8", "Masolmane Firmalelbalmore", "-"), ("12", "Kilor Tolbusoranmark", "barenurfleheim@inbox.example"),
]


def test_people(spark):
    nick = spark.createDataFrame([("Kilor", "Kily"), ("Kerkel", "Kery"), (None, "x"), ("Masolmane", "Mas")], "given_name string, short_form string")
    df = spark.createDataFrame([(*p, 1) for p in PEOPLE], "id string, name string, email string, family int")
    got = {tuple(r) for r in names.variant_pairs(df, nick).collect()}
    kilor = ["1", "2", "3", "6"]
    assert got == {(a, b) for a in kilor for b in kilor if a < b} | {("4", "7"), ("8", "9")}
    assert names.variant_pairs(df.limit(0), nick).collect() == []
    assert len(names.variant_pairs(df, nick.limit(0)).collect()) >= 3


def test_components(spark):
    nodes = spark.createDataFrame([(f"{i:03}",) for i in range(60)], "node string")
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("050", "055")], "a string, b string")
    got = {r.node: r.component for r in components.components(nodes, edges).collect()}
    assert got == {f"{i:03}": "000" if i <= 40 else ("050" if i == 55 else f"{i:03}") for i in range(60)}


@settings(max_examples=60, deadline=None)
@given(a=st.text(alphabet="abc", max_size=7), b=st.text(alphabet="abc", max_size=7))
def test_edits(a, b):
    def slow(x, y):
        d = np.zeros((len(x) + 1, len(y) + 1), int)
        d[:, 0], d[0] = range(len(x) + 1), range(len(y) + 1)
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[-1, -1]

    assert names.edits(a, b, 3) == min(4, slow(a, b))


def quality_documents(n=240):
    r = random.Random(7)
    words = "the of and to a in is it that for on with as are this be at by from or".split()
    nouns = "loop draft reader table section marker answer circle".split()
    out = []
    for i in range(n):
        kind = ("prose", "prose", "prose", "list", "table", "junk")[i % 6]
        if kind == "prose":
            t = " ".join(" ".join(r.choice(words) if k % 2 else r.choice(nouns) for k in range(r.randint(8, 16))).capitalize() + "." for _ in range(r.randint(3, 9)))
        elif kind == "list":
            t = "\n".join(f"- {r.choice(nouns)} {r.choice(nouns)}" for _ in range(r.randint(6, 20)))
        elif kind == "table":
            t = "\n".join("\t".join(str(r.randint(0, 999)) for _ in range(4)) for _ in range(r.randint(6, 20)))
        else:
            t = "".join(r.choice("#*/\\<>=|~+-_ ") for _ in range(r.randint(80, 400)))
        out.append((i, t, kind))
    return out


def test_quality(spark):
    rows = quality_documents()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (903, "word " * 20_000, "x")], "doc_id bigint, text string, label string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows[:120]] + [(5000, "list"), (1, None)], "doc_id bigint, label string")
    common = spark.createDataFrame([("en", w) for w in "the of and to a in is it that for".split()] + [("de", None)], "lang string, word string")
    got = {r.doc_id: r for r in quality.as_columns(quality.judged(docs, common, labels)).collect()}
    assert len(got) == 244 and all(got[i]["class"] is None and got[i].words is None for i in (900, 901, 902))
    right = sum(got[i]["class"] == k for i, _, k in rows[120:])
    assert right >= 0.97 * len(rows[120:])
    assert all(r["class"] is None for r in quality.judged(docs, common, labels.limit(0)).collect())
    assert quality.judged(docs.limit(0), common, labels).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=1, max_size=60))
def test_statistics_are_finite(text):
    assert np.isfinite(quality.statistics(text, {"en": {"the"}})).all()
