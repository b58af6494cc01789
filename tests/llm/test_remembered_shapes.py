from __future__ import annotations

import pytest

from marquetry.llm.java_grammar import _Parser, java_parses


@pytest.mark.parametrize("before", ["", "while (x) ", "for (int i : j) ", "l: ", "if (x) "])
def test_if_is_remembered_and_an_else_follows(monkeypatch, before):
    for shapes in ("good_statements", "good_headers", "good_conditions"):
        monkeypatch.setattr(_Parser, shapes, set())
    method = "class A { void f() { %s } }"
    assert java_parses(method % f"{before}if (a) return;")
    assert java_parses(method % f"{before}if (a) return; else b();")
    assert java_parses(method % f"if (y) {before}if (a) return; else b(); else c();")
    assert java_parses(method % f"do {before}if (a) return; else b(); while (c);")
    assert not java_parses(method % "return; else b();")
    assert not java_parses(method % f"{before}if (a) return; else b(); else c(); else d();")
