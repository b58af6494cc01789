"""Classes and display labels as CASE expressions. Thresholds are fixed values of the data contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (class, lower bound) in order, then the class of the rest; bounds of `at_least` include equality.
ABOVE = {
    "clone": ((("high", 50), ("medium", 25)), "low"),
    "complexity": ((("high", 20), ("medium", 10)), "low"),
    "badge": ((("red", 70), ("orange", 40)), "green"),
    "similarity": ((("high", 70), ("medium", 40)), "low"),
    "section": ((("high", 30), ("medium", 15)), "low"),
    "history": ((("warning", 30),), "success"),
}
AT_LEAST = {"maintainability": ((("good", 60), ("medium", 30)), "low")}
# File kinds by extension and their display labels.
FILE_KINDS = {"zip": "zip", "java": "java", "py": "python"}
KIND_LABELS = {"zip": "ZIP", "java": "Java", "python": "Python", "text": "Text"}
KIND_ICONS = {"zip": "ZIP", "java": "JV", "python": "PY", "text": "TXT"}


def klass(value: Column, scale: str) -> Column:
    """Class of a number on a scale; null takes the lowest class."""
    strict = scale in ABOVE
    bounds, rest = (ABOVE if strict else AT_LEAST)[scale]
    out = None
    for name, bound in bounds:
        test = value > bound if strict else value >= bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(rest)


def batch_flag(clone: Column) -> Column:
    """Severity of a flagged file: null up to 30 %."""
    return F.when(clone > 30, F.when(clone > 50, "high").otherwise("medium"))


def file_kind(ext: Column) -> Column:
    """Kind of a file by its extension (see sources.files.extension); text for all others."""
    return F.coalesce(*[F.when(ext == k, v) for k, v in FILE_KINDS.items()], F.lit("text"))


def kind_label(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in KIND_LABELS.items()], F.lit("File"))


def kind_icon(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in KIND_ICONS.items()], F.lit("F"))


def size_label(size: Column) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    unit = lambda d, u: F.concat(F.round(size / d, 1).cast("string"), F.lit(u))
    return F.when(size >= 1048576, unit(1048576.0, " MB")).when(size >= 1024, unit(1024.0, " KB")).otherwise(F.concat(size.cast("string"), F.lit(" B")))


# Date patterns in use, by name.
DATE_PATTERNS = {"day": "MMM d, yyyy", "long_day": "MMMM d, yyyy", "moment": "MMM d, hh:mm a"}


def day_label(ts: Column, pattern: str = "day") -> Column:
    return F.date_format(ts, DATE_PATTERNS[pattern])


def iso_label(ts: Column) -> Column:
    """ISO form without zone; microseconds only where there are any. Null stays null."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def age_label(ts: Column, now: Column) -> Column:
    """How long ago: seconds, minutes, hours, Yesterday, days, weeks. Future times count as just now; null stays null."""
    s = F.expr("1L") * F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(1_000_000))
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    few = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))
    return (
        F.when(ts.isNull(), F.lit(None).cast("string"))
        .when(s < 60, "Just now")
        .when(m < 60, few(m, "minute"))
        .when(h < 24, few(h, "hour"))
        .when(d == 1, "Yesterday")
        .when(d < 7, F.concat(d.cast("string"), F.lit(" days ago")))
        .when(d < 14, "1 week ago")
        .otherwise(F.concat(F.floor(d / 7).cast("string"), F.lit(" weeks ago")))
    )


def rounded(value: Column) -> Column:
    """Half up to an integer."""
    return F.floor(value + 0.5)


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
