"""A recogniser for Java 17 source files (syntax only, no names, no types).

The text becomes a string of terminals, one character per token, so identifiers and literals lose their spelling. Statements
and headers of equal shape are then equal strings, and a shape that was accepted once is accepted again by a dictionary
lookup. What is new is parsed by recursive descent over the whole grammar.
"""

from __future__ import annotations

import re
import sys

# Terminals. Reserved words and operators by the character that stands for them.
WORDS = {
    "public": "m", "protected": "m", "private": "m", "abstract": "m", "native": "m", "transient": "m", "volatile": "m", "strictfp": "m",
    "static": "S", "final": "f", "synchronized": "y", "default": "d", "int": "p", "long": "p", "short": "p", "byte": "p", "char": "p", "boolean": "p", "float": "p", "double": "p", "void": "v",
    "class": "C", "interface": "I", "enum": "N", "extends": "x", "implements": "X", "throws": "T", "package": "P", "import": "M", "if": "F", "else": "e", "while": "W", "do": "D", "for": "O",
    "switch": "w", "case": "k", "return": "r", "break": "b", "continue": "q", "throw": "t", "try": "Y", "catch": "K", "finally": "l", "assert": "A", "new": "Z", "this": "h", "super": "H", "instanceof": "z",
    "true": "n", "false": "n", "null": "n", "const": "\x01", "goto": "\x01", "_": "\x01",
    "record": "1", "sealed": "2", "permits": "3", "yield": "4", "var": "5", "non": "6", "module": "7", "open": "8",
}
OPERATORS = {
    "->": "L", "::": "R", "...": "E", "++": "u", "--": "u", "!": "!", "~": "!", "/": "o", "%": "o", "^": "o", "||": "o", "&&": "o", "==": "o", "!=": "o", "<=": "o", ">=": "o", "<<": "o",
    "+=": "a", "-=": "a", "*=": "a", "/=": "a", "&=": "a", "|=": "a", "^=": "a", "%=": "a", "<<=": "a", ">>=": "a", ">>>=": "a", ">>": "G>", ">>>": "GG>",
}
NAMES = "i12345678"  # identifiers, contextual words included

_TOKEN = re.compile(
    "|".join(
        (
            r"(?:\s|//[^\n\r]*|/\*[\s\S]*?\*/)+",
            r"[^\W\d][\w$]*|\$[\w$]*",
            r"0[xX](?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)?(?:\.(?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)?)?[pP][+-]?\d(?:[\d_]*\d)?[fFdD]?|0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?",
            r"(?:\d(?:[\d_]*\d)?\.?(?:\d(?:[\d_]*\d)?)?|\.\d(?:[\d_]*\d)?)(?:[eE][+-]?\d(?:[\d_]*\d)?)?[fFdDlL]?",
            r"\"\"\"[ \t\f]*(?:\r\n|\n|\r)(?:[^\\]|\\(?:[btnfrs\"'\\0-7]|\r\n|\n|\r))*?\"\"\"",
            r"\"(?:[^\"\\\n\r]|\\[btnfrs\"'\\0-7])*\"",
            r"'(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{1,2}))'",
            r">>>=|<<=|>>=|>>>|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<|>>|[-+*/&|^%]=|[-+*/&|^%!~<>=?:;,.@(){}\[\]]",
        )
    )
)
_ESCAPE = re.compile(r"(?<!\\)((?:\\\\)*)\\u+([0-9a-fA-F]{4})")
# Shapes of more terminals than this are always parsed.
_SIMPLE = re.compile(r"[^;{}]{0,400};")
_HEADER = re.compile(r"[^;{}=@]{0,400}\{")
_CLOSE = {")": "(", "]": "[", "}": "{"}


class Bad(Exception):
    """Not Java."""


def terminals(text: str) -> str:
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: m[1] + chr(int(m[2], 16)), text)
    text = text.removesuffix("\x1a")
    if text.startswith("\ufeff"):
        text = text[1:]
    tokens = _TOKEN.findall(text)
    if sum(map(len, tokens)) != len(text):
        raise Bad
    out = []
    for t in tokens:
        c = _KNOWN.get(t)
        if c is None:
            a = t[0]
            if a.isspace() or t.startswith(("//", "/*")):
                continue
            c = "n" if a in "\"'.0123456789" and t != "." else "i" if a.isalpha() or a in "_$" else t
        out.append(c)
    return "".join(out)


_KNOWN = WORDS | OPERATORS


class _Parser:
    good_statements: set[str] = set()
    good_headers: set[str] = set()
    good_conditions: set[str] = set()
    LIMIT = 200_000

    def __init__(self, s: str) -> None:
        self.s, self.p = s + "\0", 0
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", s):
            c = m[0]
            if c in "([{":
                stack.append(m.start())
            else:
                if not stack or s[stack[-1]] != _CLOSE[c]:
                    raise Bad
                self.match[stack.pop()] = m.start()
        if stack:
            raise Bad

    # small helpers
    def at(self, chars: str, ahead: int = 0) -> bool:
        i = self.p + ahead
        return i < len(self.s) and self.s[i] in chars

    def take(self, chars: str) -> bool:
        if self.s[self.p] in chars:
            self.p += 1
            return True
        return False

    def need(self, chars: str) -> None:
        if self.s[self.p] not in chars or self.s[self.p] == "\0":
            raise Bad
        self.p += 1

    def trying(self, rule) -> bool:
        p = self.p
        try:
            rule()
            return True
        except Bad:
            self.p = p
            return False

    def listed(self, rule, sep: str = ",") -> None:
        rule()
        while self.take(sep):
            rule()

    def name(self) -> None:
        self.need(NAMES)

    def qualified(self) -> None:
        self.name()
        while self.at(".") and self.at(NAMES, 1):
            self.p += 2

    # types
    def annotations(self) -> None:
        while self.at("@") and not self.at("I", 1):
            self.annotation()

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.take("("):
            if not self.at(")"):
                if self.at(NAMES) and self.at("=", 1):
                    self.listed(self.pair)
                else:
                    self.element()
            self.need(")")

    def pair(self) -> None:
        self.name()
        self.need("=")
        self.element()

    def element(self) -> None:
        if self.at("@"):
            self.annotation()
        elif self.take("{"):
            while not self.at("}"):
                if self.at(",") and self.at("}", 1):
                    self.p += 1
                    break
                self.element()
                if not self.at("}"):
                    self.need(",")
            self.need("}")
        else:
            self.ternary()

    def type_arguments(self, diamond: bool = False) -> None:
        self.need("<")
        if diamond and self.take(">"):
            return
        self.listed(self.type_argument)
        self.need(">G")

    def type_argument(self) -> None:
        self.annotations()
        if self.take("?"):
            if self.take("xH"):
                self.type()
        else:
            self.type()
            if self.s[self.p - 1] == "p":
                raise Bad

    def class_type(self, diamond: bool = False) -> None:
        self.annotations()
        self.name()
        while True:
            if self.at("<"):
                self.type_arguments(diamond)
            if self.at(".") and (self.at(NAMES, 1) or self.at("@", 1)):
                self.p += 1
                self.annotations()
                self.name()
            else:
                return

    def type(self, dims: bool = True) -> None:
        self.annotations()
        if not self.take("p"):
            self.class_type()
        if dims:
            self.dims()

    def dims(self) -> None:
        while True:
            if self.at("[") and self.at("]", 1):
                self.p += 2
            elif self.at("@"):
                p = self.p
                self.annotations()
                if not (self.at("[") and self.at("]", 1)):
                    self.p = p
                    return
            else:
                return

    def type_parameters(self) -> None:
        self.need("<")
        self.listed(self.type_parameter)
        self.need(">G")

    def type_parameter(self) -> None:
        self.annotations()
        self.name()
        if self.take("x"):
            self.listed(self.class_type, "&")

    # declarations
    def unit(self) -> None:
        p = self.p
        if self.trying(self.annotations) and self.take("P"):
            self.qualified()
            self.need(";")
        else:
            self.p = p
        while self.at("M;"):
            if self.take(";"):
                continue
            self.p += 1
            self.take("S")
            self.qualified()
            if self.take("."):
                self.need("*")
            self.need(";")
        if self.at("78@") and self.trying(self.module):
            self.need("\0") if self.s[self.p] != "\0" else None
            return
        while not self.at("\0"):
            if self.take(";"):
                continue
            self.modifiers()
            self.type_declaration()

    def module(self) -> None:
        self.annotations()
        self.take("8")
        self.need("7")
        self.qualified()
        self.need("{")
        while not self.at("}"):
            self.name()
            while not self.at(";"):
                self.need(NAMES + ".,S")
            self.need(";")
        self.need("}")
        if not self.at("\0"):
            raise Bad

    def modifiers(self) -> None:
        while True:
            if self.at("@") and not self.at("I", 1):
                self.annotation()
            elif self.at("d") and self.at(":L", 1):
                return
            elif self.at("mSfyd"):
                self.p += 1
            elif self.at("2") and self.at("mSfyCI2@6", 1):
                self.p += 1
            elif self.at("6") and self.at("-", 1) and self.at("2", 2):
                self.p += 3
            else:
                return

    def starts_type(self) -> bool:
        return self.at("CIN") or (self.at("@") and self.at("I", 1)) or (self.at("1") and self.at(NAMES, 1) and self.at("(<", 2))

    def type_declaration(self) -> None:
        if self.take("C"):
            self.name()
            if self.at("<"):
                self.type_parameters()
            if self.take("x"):
                self.class_type()
            self.interfaces("X")
            self.interfaces("3")
            self.body("class")
        elif self.take("I"):
            self.name()
            if self.at("<"):
                self.type_parameters()
            self.interfaces("x")
            self.interfaces("3")
            self.body("interface")
        elif self.take("N"):
            self.name()
            self.interfaces("X")
            self.enum_body()
        elif self.at("@"):
            self.p += 1
            self.need("I")
            self.name()
            self.body("annotation")
        elif self.at("1") and self.at(NAMES, 1):
            self.p += 2
            if self.at("<"):
                self.type_parameters()
            self.parameters(record=True)
            self.interfaces("X")
            self.body("record")
        else:
            raise Bad

    def interfaces(self, word: str) -> None:
        if self.take(word):
            self.listed(self.class_type)

    def enum_body(self) -> None:
        self.need("{")
        while not self.at(";}"):
            if self.at(",") and self.at(";}", 1):
                self.p += 1
                break
            self.annotations()
            self.name()
            if self.at("("):
                self.arguments()
            if self.at("{"):
                self.body("class")
            if not self.at(";}"):
                self.need(",")
        if self.take(";"):
            while not self.at("}"):
                self.member("class")
        self.need("}")

    def body(self, kind: str) -> None:
        self.need("{")
        while not self.at("}"):
            self.member(kind)
        self.need("}")

    def member(self, kind: str) -> None:
        if self.take(";"):
            return
        m = _HEADER.match(self.s, self.p)
        if m and m[0] in self.good_headers:
            self.p = m.end() - 1
            self.block()
            return
        start = self.p
        if self.at("{") or (self.at("S") and self.at("{", 1)):
            self.take("S")
            self.block()
            return
        self.modifiers()
        if self.starts_type():
            self.type_declaration()
            return
        if self.at("<"):
            self.type_parameters()
            self.annotations()
        if kind == "record" and self.at(NAMES) and self.at("{", 1):
            self.p += 1
            self.block()
            return
        if self.at(NAMES) and self.at("(", 1):
            self.p += 1
            self.method_rest(start)
            return
        if not self.take("v"):
            self.type()
        elif not (self.at(NAMES) and self.at("(", 1)):
            raise Bad
        self.name()
        if self.at("("):
            self.method_rest(start)
            return
        self.declarators()
        self.need(";")

    def method_rest(self, start: int) -> None:
        self.parameters()
        self.dims()
        if self.take("T"):
            self.listed(self.class_type)
        if self.take("d"):
            self.element()
        if self.take(";"):
            return
        if not self.at("{"):
            raise Bad
        header = self.s[start : self.p + 1]
        if len(self.good_headers) < self.LIMIT and "{" not in header[:-1] and "=" not in header and "@" not in header:
            self.good_headers.add(header)
        self.block()

    def parameters(self, record: bool = False) -> None:
        self.need("(")
        last = False
        if not self.at(")"):
            while True:
                if last:
                    raise Bad
                self.modifiers()
                self.type()
                self.annotations()
                last = self.take("E")
                if self.at("h"):
                    self.p += 1
                elif self.at(NAMES) and self.at(".", 1):
                    while self.at(NAMES) and self.at(".", 1):
                        self.p += 2
                    self.need("h")
                else:
                    self.name()
                    self.dims()
                if not self.take(","):
                    break
        self.need(")")

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.take("="):
                self.initialiser()
            if not self.take(","):
                return
            self.name()

    def initialiser(self) -> None:
        if self.take("{"):
            while not self.at("}"):
                if self.at(",") and self.at("}", 1):
                    self.p += 1
                    break
                self.initialiser()
                if not self.at("}"):
                    self.need(",")
            self.need("}")
        else:
            self.expression()

    # statements
    def remembered(self, m: re.Match[str] | None) -> bool:
        """Whether a shape was accepted before; not where an `else` follows that an `if` in it has to take."""
        return m is not None and m[0] in self.good_statements and not (self.s[m.end()] == "e" and "F" in m[0])

    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            self.block_statement()
        self.need("}")

    def block_statement(self) -> None:
        m = _SIMPLE.match(self.s, self.p)
        if self.remembered(m):
            self.p = m.end()
            return
        start = self.p
        if self.at("mSfy@d2") or (self.at("6") and self.at("-", 1)) or self.starts_type():
            if not (self.at("y") and self.at("(", 1)) and not (self.at("d") and self.at(":L", 1)) and not (self.at("2") and not self.at("mSfyCI", 1)):
                self.modifiers()
                if self.starts_type():
                    self.type_declaration()
                else:
                    self.type()
                    self.name()
                    self.declarators()
                    self.need(";")
                return
        if self.at("p" + NAMES) and self.trying(self.local_variable):
            pass
        else:
            self.statement()
        if m and self.p == m.end() and len(self.good_statements) < self.LIMIT:
            self.good_statements.add(self.s[start : self.p])

    def local_variable(self) -> None:
        if self.at("4") and not self.at("i", 1):
            raise Bad
        self.type()
        self.name()
        if not self.at("=;,["):
            raise Bad
        self.declarators()
        self.need(";")

    def condition(self) -> None:
        end = self.match.get(self.p)
        if end is None:
            raise Bad
        shape = self.s[self.p : end + 1]
        if shape in self.good_conditions:
            self.p = end + 1
            return
        self.need("(")
        self.expression()
        self.need(")")
        if len(self.good_conditions) < self.LIMIT and "{" not in shape:
            self.good_conditions.add(shape)

    def statement(self) -> None:
        c = self.s[self.p]
        if c == "{":
            self.block()
        elif c == ";":
            self.p += 1
        elif c == "F":
            self.p += 1
            self.condition()
            self.statement_only()
            while self.at("e"):
                self.p += 1
                if self.at("F"):
                    self.p += 1
                    self.condition()
                    self.statement_only()
                else:
                    self.statement_only()
                    return
        elif c == "W":
            self.p += 1
            self.condition()
            self.statement_only()
        elif c == "D":
            self.p += 1
            self.statement_only()
            self.need("W")
            self.condition()
            self.need(";")
        elif c == "O":
            self.p += 1
            self.for_rest()
        elif c == "w":
            self.p += 1
            p = self.p
            self.condition()
            self.switch_body()
            if self.at(".["):  # a switch expression as the start of an expression statement
                self.p = p - 1
                self.expression_statement()
        elif c == "r":
            self.p += 1
            if not self.at(";"):
                self.expression()
            self.need(";")
        elif c in "bq":
            self.p += 1
            self.take(NAMES)
            self.need(";")
        elif c == "t":
            self.p += 1
            self.expression()
            self.need(";")
        elif c == "Y":
            self.p += 1
            self.try_rest()
        elif c == "y":
            self.p += 1
            self.condition()
            self.block()
        elif c == "A":
            self.p += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";")
        elif c == "4" and not self.at("=.([uaR:", 1) and not (self.at("i", 1) and self.at("=;", 2) and False):
            self.p += 1
            self.expression()
            self.need(";")
        elif c in NAMES and self.at(":", 1):
            self.p += 2
            self.statement_only()
        else:
            self.expression_statement()

    def statement_only(self) -> None:
        m = _SIMPLE.match(self.s, self.p)
        if self.remembered(m) and not self.at("p") and self.s[self.p] not in "mSf@":
            # a declaration is no statement here; shapes with two names in a row are parsed
            if not re.match(r"[i1-8p][^=(]*[>\]i1-8][i1-8]", m[0]):
                self.p = m.end()
                return
        self.statement()

    def expression_statement(self) -> None:
        start = self.p
        prefix = self.at("u")
        kind = self.expression()
        if not prefix and kind not in ("assign", "call", "step"):
            raise Bad
        if start == self.p:
            raise Bad
        self.need(";")

    def for_rest(self) -> None:
        self.need("(")
        p = self.p
        if self.trying(self.for_each_head):
            self.expression()
        else:
            self.p = p
            if not self.take(";"):
                if not self.trying(self.for_variables):
                    self.listed(self.step_expression)
                    self.need(";")
            if not self.take(";"):
                self.expression()
                self.need(";")
            if not self.at(")"):
                self.listed(self.step_expression)
        self.need(")")
        self.statement_only()

    def for_each_head(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        self.dims()
        self.need(":")

    def for_variables(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        if not self.at("=;,["):
            raise Bad
        self.declarators()
        self.need(";")

    def step_expression(self) -> None:
        prefix = self.at("u")
        if self.expression() not in ("assign", "call", "step") and not prefix:
            raise Bad

    def try_rest(self) -> None:
        any_ = False
        if self.take("("):
            any_ = True
            while True:
                if not self.trying(self.resource_variable):
                    self.expression()
                if not self.take(";") or self.at(")"):
                    break
            self.need(")")
        self.block()
        while self.take("K"):
            any_ = True
            self.need("(")
            self.modifiers()
            self.listed(self.class_type, "|")
            self.name()
            self.need(")")
            self.block()
        if self.take("l"):
            any_ = True
            self.block()
        if not any_:
            raise Bad

    def resource_variable(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        self.need("=")
        self.expression()

    def switch_body(self) -> None:
        self.need("{")
        arrows = None
        while not self.at("}"):
            if self.take("k"):
                self.listed(self.case_label)
            else:
                self.need("d")
            arrow = self.at("L")
            self.need("L:")
            if arrows is not None and arrows != arrow:
                raise Bad
            arrows = arrow
            if arrow:
                if self.at("{"):
                    self.block()
                elif self.at("t"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                while not self.at("}k") and not (self.at("d") and self.at(":L", 1)):
                    self.block_statement()
        self.need("}")

    def case_label(self) -> None:
        self.ternary()

    # expressions; each returns what kind it is: assign, call, step, or something else
    def expression(self) -> str:
        if self.lambda_ahead():
            return self.lambda_rest()
        kind = self.ternary()
        if self.at("=a"):
            self.p += 1
            self.expression()
            return "assign"
        return kind

    def lambda_ahead(self) -> bool:
        if self.at(NAMES) and self.at("L", 1):
            return True
        if self.at("("):
            end = self.match.get(self.p)
            return end is not None and self.s[end + 1] == "L"
        return False

    def lambda_rest(self) -> str:
        if self.at("("):
            self.p += 1
            if not self.at(")"):
                if self.at(NAMES) and self.at(",)", 1):
                    self.listed(self.name)
                    self.need(")")
                else:
                    self.p -= 1
                    self.parameters()
            else:
                self.p += 1
        else:
            self.p += 1
        self.need("L")
        if self.at("{"):
            self.block()
        else:
            self.expression()
        return "lambda"

    def ternary(self) -> str:
        kind = self.binary()
        if self.take("?"):
            if self.lambda_ahead():
                self.lambda_rest()
            else:
                self.expression()
            self.need(":")
            if self.lambda_ahead():
                self.lambda_rest()
            else:
                self.ternary()
            return "other"
        return kind

    def binary(self) -> str:
        kind = self.unary()
        while True:
            c = self.s[self.p]
            if c in "o*+-&|<>":
                self.p += 1
            elif c == "G":
                self.p += 1
                self.take("G")
                self.need(">")
            elif c == "z":
                self.p += 1
                self.modifiers()
                self.type()
                self.take(NAMES)
                kind = "other"
                continue
            else:
                return kind
            kind = "other"
            if self.lambda_ahead():
                raise Bad
            self.unary()

    def unary(self) -> str:
        depth = 0
        while self.at("+-!u"):
            self.p += 1
            depth += 1
        if self.at("(") and self.cast():
            return "other"
        kind = self.primary()
        while self.at("u"):
            self.p += 1
            kind = "step"
        return "other" if depth else kind

    def cast(self) -> bool:
        p = self.p
        end = self.match.get(p)
        if end is None:
            raise Bad
        try:
            self.p += 1
            primitive = self.at("p")
            self.type()
            while self.take("&"):
                self.type()
            if self.p != end:
                raise Bad
            self.p += 1
            if not primitive or self.s[end - 1] == "]":
                if not self.at(NAMES + "n(!hHZpvw@"):
                    raise Bad
            if self.lambda_ahead():
                self.lambda_rest()
            else:
                self.unary()
            return True
        except Bad:
            self.p = p
            return False

    def arguments(self) -> None:
        self.need("(")
        if not self.at(")"):
            self.listed(self.expression)
        self.need(")")

    def reference_type(self) -> None:
        """A type that only a method reference or a class literal can follow."""
        self.type()
        if self.s[self.p - 1] not in ">G]" or not (self.at("R") or (self.at(".") and self.at("C", 1))):
            raise Bad

    def primary(self) -> str:
        c = self.s[self.p]
        kind = "other"
        if c in NAMES:
            if self.at("<[@.", 1):
                if not self.trying(self.reference_type):
                    self.p += 1
            else:
                self.p += 1
            if self.at("("):
                self.arguments()
                kind = "call"
        elif c == "n":
            self.p += 1
        elif c == "(":
            self.p += 1
            self.expression()
            self.need(")")
        elif c in "hH":
            self.p += 1
            if self.at("("):
                self.arguments()
                kind = "call"
            elif c == "H" and not self.at(".R"):
                raise Bad
        elif c == "Z":
            self.p += 1
            kind = self.creator()
        elif c in "pv":
            self.p += 1
            self.dims()
            if self.at("R") and c == "p":
                pass
            elif self.at(".") and self.at("C", 1):
                pass
            else:
                raise Bad
        elif c == "w":
            self.p += 1
            self.condition()
            self.switch_body()
        elif c == "@":
            if not self.trying(self.reference_type):
                raise Bad
        else:
            raise Bad
        return self.selectors(kind)

    def creator(self) -> str:
        self.annotations()
        if self.at("<"):
            self.type_arguments()
        if not self.take("p"):
            self.class_type(diamond=True)
        elif not self.at("[@"):
            raise Bad
        self.annotations()
        if self.at("["):
            if self.at("]", 1):
                self.dims()
                if not self.at("{"):
                    raise Bad
                self.initialiser()
            else:
                while self.at("[") and not self.at("]", 1):
                    self.p += 1
                    self.expression()
                    self.need("]")
                    self.annotations()
                self.dims()
            return "other"
        self.arguments()
        if self.at("{"):
            self.body("class")
        return "call"

    def selectors(self, kind: str) -> str:
        while True:
            c = self.s[self.p]
            if c == ".":
                self.p += 1
                if self.at("<"):
                    self.type_arguments()
                    if self.at("H"):
                        self.p += 1
                    else:
                        self.name()
                    self.arguments()
                    kind = "call"
                elif self.take("Ch"):
                    kind = "other"
                elif self.take("H"):
                    kind = "other"
                    if self.at("("):
                        self.arguments()
                        kind = "call"
                    elif not self.at(".R"):
                        raise Bad
                elif self.take("Z"):
                    kind = self.creator()
                else:
                    self.name()
                    kind = "other"
                    if self.at("("):
                        self.arguments()
                        kind = "call"
            elif c == "[":
                self.p += 1
                self.expression()
                self.need("]")
                kind = "other"
            elif c == "R":
                self.p += 1
                if self.at("<"):
                    self.type_arguments()
                self.need(NAMES + "Z")
                kind = "other"
            elif c == "u":
                self.p += 1
                kind = "step"
                return kind
            else:
                return kind


#: Frames of the parser that a nested text may need: they lie on the heap, a few hundred bytes each, so memory is the only limit.
DEEPEST = 1 << 30


def java_parses(text: str) -> bool:
    """Is the text a syntactically valid Java 17 source file? However deeply it is nested: a process without the memory to tell raises."""
    shallow = sys.getrecursionlimit()
    try:
        return _parses(text)
    except RecursionError:
        sys.setrecursionlimit(DEEPEST)
        try:
            return _parses(text)
        finally:
            sys.setrecursionlimit(shallow)


def _parses(text: str) -> bool:
    try:
        p = _Parser(terminals(text))
        p.unit()
        return p.s[p.p] == "\0"
    except (Bad, OverflowError, ValueError):
        return False
