"""Per-document metrics as pure projections over the scan: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.functions import labels as L
from marquetry.functions import text as X

# Keywords that count once for each line that contains them; substrings overlap on purpose.
KEYWORDS = {
    "python": ("if ", "elif ", "for ", "while ", "except ", "and ", "or "),
    "java": ("if ", "else if", "for ", "while ", "catch ", "&&", "||", "case "),
}
SHORTEST_DUPLICATE = 5
SHORTEST_CLONE = 10


def duplicate_lines(lines: Column) -> Column:
    """Repeats of trimmed lines longer than 5 characters beyond their first occurrence."""
    long = F.filter(F.transform(lines, X.trimmed), lambda x: F.length(x) > SHORTEST_DUPLICATE)
    return F.size(long) - F.size(F.array_distinct(long))


def complexity_of(lines: Column, language: Column) -> Column:
    """1 + for each line the number of keywords it contains; every language but Python, unknown and null ones too, uses the Java list."""

    def points(words: tuple[str, ...]) -> Column:
        hits = lambda line: sum((F.contains(line, F.lit(w)).cast("int") for w in words[1:]), F.contains(line, F.lit(words[0])).cast("int"))
        return F.aggregate(lines, F.lit(0), lambda acc, line: acc + hits(line))

    return F.lit(1) + F.when(language == "python", points(KEYWORDS["python"])).otherwise(points(KEYWORDS["java"]))


def document_metrics(df: DataFrame, text: str, language: Column | None = None) -> DataFrame:
    """Adds lines_of_code, total_lines, duplicate_lines, clone_percentage, cyclomatic_complexity, maintainability_index.

    Null text counts as empty: 1 line of code, 0 total lines, clone 0, complexity 1, maintainability 98. Without `language` all
    texts are measured by the Python list.
    """
    lang = F.lower(X.trimmed(language)) if language is not None else F.lit("python")
    out = df.withColumn("_lines", X.solid_lines(F.col(text)))
    out = out.select(
        "*",
        X.line_count(F.col(text)).cast("bigint").alias("lines_of_code"),
        F.size("_lines").cast("bigint").alias("total_lines"),
        duplicate_lines(F.col("_lines")).cast("bigint").alias("duplicate_lines"),
        complexity_of(F.col("_lines"), lang).cast("bigint").alias("cyclomatic_complexity"),
    ).drop("_lines")
    ratio = F.when(F.col("total_lines") > 0, F.floor(F.col("duplicate_lines") / F.greatest(F.col("total_lines"), F.lit(1)) * 1000 + 0.5) / 10).otherwise(0.0)
    out = out.withColumn("clone_percentage", ratio)
    score = L.clamped(L.rounded(F.lit(100.0) - 2 * F.col("cyclomatic_complexity") - 0.5 * F.col("clone_percentage")), 0, 100)
    return out.withColumn("maintainability_index", score.cast("bigint"))


def suggestions(df: DataFrame) -> DataFrame:
    """One row per rule that fires on the metrics of document_metrics; documents without a suggestion give no row."""
    rule = lambda test, name, prio: F.when(test, F.struct(F.lit(name).alias("refactoring_type"), F.lit(prio).alias("priority")))
    fired = F.array(rule(F.col("clone_percentage") > 10, "Extract Method", 1), rule(F.col("cyclomatic_complexity") > 10, "Simplify Conditionals", 2))
    return df.withColumn("_s", F.explode(F.filter(fired, lambda x: x.isNotNull()))).select("*", "_s.refactoring_type", "_s.priority").drop("_s")


def outline_spans(df: DataFrame) -> DataFrame:
    """Two placeholder spans derived from lines_of_code where it is at least 6: a quarter and half way down, 5 lines each."""
    n = F.col("lines_of_code")
    span = lambda no, part: F.struct(F.lit(no).alias("span_no"), F.greatest(F.lit(1), F.expr(f"lines_of_code div {part}")).alias("start_line"), F.greatest(F.lit(5), F.expr(f"lines_of_code div {part} + 5")).alias("end_line"))
    spans = F.when(n >= 6, F.array(span(1, 4), span(2, 2))).otherwise(F.array())
    return df.withColumn("_s", F.explode(spans)).select("*", "_s.span_no", "_s.start_line", "_s.end_line").drop("_s")


def default_suggestion(df: DataFrame) -> DataFrame:
    """The one standing suggestion for documents of at least 4 lines; null for shorter ones."""
    return df.withColumn("refactoring_type", F.when(F.col("lines_of_code") >= 4, "Extract Method")).withColumn("priority", F.when(F.col("lines_of_code") >= 4, 1))


def class_histogram(df: DataFrame) -> DataFrame:
    """Documents by metric and class: (metric, class, documents)."""
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), L.klass(F.col(c), s).alias("class"))
            for m, c, s in (("clone", "clone_percentage", "clone"), ("complexity", "cyclomatic_complexity", "complexity"), ("maintainability", "maintainability_index", "maintainability"))
        ]
    )
    return df.select(F.explode(pairs).alias("p")).groupBy(F.col("p.metric").alias("metric"), F.col("p.class").alias("class")).agg(F.count("*").alias("documents"))


# Reserved words per language, used for tagging and counting.
RESERVED = {
    "python": "def class if elif else for while return import from as try except finally with yield lambda pass break continue and or not in is True False None print self raise del global nonlocal assert".split(),
    "java": "public private protected static final class interface extends implements void int double float boolean String char long short byte if else for while do switch case break continue return new this super try catch finally throw throws import package null true false abstract synchronized".split(),
}
NUMBER = r"\b(\d+\.?\d*)\b"
CALL = r"\b([A-Za-z_]\w*)\s*\("


def token_counts(df: DataFrame, text: str, language: Column) -> DataFrame:
    """Adds numbers, calls, keywords and comment_lines (Python's words and # for Python, Java's and // for all others). Null text counts as empty."""
    t, python = F.coalesce(F.col(text), F.lit("")), F.lower(X.trimmed(F.coalesce(language, F.lit("")))) == "python"
    kw = lambda lang: F.regexp_count(t, F.lit(r"\b(" + "|".join(RESERVED[lang]) + r")\b"))
    lines = lambda mark: F.size(F.filter(X.newline_parts(t), lambda x: F.startswith(X.left_trimmed(x), F.lit(mark))))
    return df.select(
        "*",
        F.regexp_count(t, F.lit(NUMBER)).cast("bigint").alias("numbers"),
        F.regexp_count(t, F.lit(CALL)).cast("bigint").alias("calls"),
        F.when(python, kw("python")).otherwise(kw("java")).cast("bigint").alias("keywords"),
        F.when(python, lines("#")).otherwise(lines("//")).cast("bigint").alias("comment_lines"),
    )


def _literal(quote: str, n: int) -> str:
    """A literal between n quotes: up to the first n that are not escaped; where there are none, up to the last escaped ones.

    Possessive loops: the JVM's regular expressions keep no stack frame per character, however long the literal is."""
    inner = rf"[^{quote}\\]|\\[\s\S]" + (rf"|{quote}(?!{quote}{{{n - 1}}})" if n > 1 else "")
    return rf"{quote}{{{n}}}(?:{inner})*+{quote}{{{n}}}|{quote}{{{n}}}[\s\S]*\\{quote}{{{n}}}"


STRING_LITERAL = "|".join(_literal(q, n) for n in (3, 1) for q in "\"'")


def string_literals(text: Column) -> Column:
    """All string literals of a code text, quotes included, each read in the order triple before single quotes."""
    return F.regexp_extract_all(text, F.lit(STRING_LITERAL), F.lit(0))
