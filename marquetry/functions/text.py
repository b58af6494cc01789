"""String functions with the exact semantics the engine promises, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the browser's trim understands it, and the line ends of the server's line split.
BLANKS = "\\t\\n\\x0B\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\u0085\u2028\u2029]"
SOURCE_SUFFIX = r"(?i)\.(py|java|txt)$"


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind (not only blanks)."""
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def left_trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANKS}]+", "")


def newline_parts(c: Column) -> Column:
    """Split at \\n only: a trailing empty part and carriage returns stay."""
    return F.split(c, "\n", -1)


def line_count(c: Column) -> Column:
    """Lines under all line ends; a trailing one opens no line; at least 1. Null counts as empty text."""
    c = F.coalesce(c, F.lit(""))
    return F.greatest(F.lit(1), F.size(F.split(c, LINE_END, -1)) - c.rlike(rf"(?:{LINE_END})\z").cast("int"))


def solid_lines(c: Column) -> Column:
    """The lines that hold more than white space, untrimmed, in order; null counts as empty text."""
    return F.filter(newline_parts(F.coalesce(c, F.lit(""))), lambda x: F.length(trimmed(x)) > 0)


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/", -1), -1)


def stem_words(c: Column) -> Column:
    """Base name without a source suffix, _ and - as blanks."""
    return F.translate(F.regexp_replace(base_name(c), SOURCE_SUFFIX, ""), "_-", "  ")


def without_blanks(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{BLANKS}]", "")


def local_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def first_word(name: Column) -> Column:
    return F.split_part(name, F.lit(" "), F.lit(1))


def shortened(c: Column, most: int = 36) -> Column:
    """At most `most` characters (code points), then three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def first_lines(c: Column, n: int = 5) -> Column:
    """The first n lines joined again; null for null or empty text."""
    return F.when(F.length(c) > 0, F.array_join(F.slice(newline_parts(c), 1, n), "\n"))


def repeated_lines(line: Column, n: Column, most: int = 5) -> Column:
    return F.array_join(F.array_repeat(line, F.least(F.lit(most), n).cast("int")), "\n")


def capitalised(c: Column) -> Column:
    """First letter upper-cased, the rest untouched."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2_000_000_000))


def plural(n: Column) -> Column:
    return F.when(n != 1, F.lit("s")).otherwise(F.lit(""))


def number_text(c: Column) -> Column:
    """A number as text, without a fraction where it is whole."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def is_hex_colour(c: Column) -> Column:
    """Is the text, without outer white space, # and six hexadecimal digits? Null for null."""
    return trimmed(c).rlike(r"^#[0-9a-fA-F]{6}\z")


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def url_component(c: Column) -> Column:
    """Percent encoding with %20 for blanks."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def from_url_component(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def falsy_to(c: Column, default: Column | str) -> Column:
    """Null and the empty string take the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def shown(c: Column) -> Column:
    """A value as text, '-' for null."""
    return F.coalesce(c.cast("string"), F.lit("-"))


def contains_ci(c: Column, needle: str) -> Column:
    """Substring test without letter case; null never matches."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))
