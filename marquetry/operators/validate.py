"""Validation verdicts as columns: the first failing rule's code, null for valid rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquetry.functions import text as X
from marquetry.functions.syntax import python_parses

LANGUAGES = ("python", "java")
SHORTEST_CODE = 4


def strict_verdict(code: Column, language: Column) -> Column:
    """Missing code, missing language, blank code, fewer than 4 characters, unsupported language (case and blanks ignored)."""
    t = X.trimmed(code)
    return (
        F.when(code.isNull(), "missing code")
        .when(language.isNull(), "missing language")
        .when(F.length(t) == 0, "empty code")
        .when(F.length(t) < SHORTEST_CODE, "code too short")
        .when(~F.lower(X.trimmed(language)).isin(*LANGUAGES), "unsupported language")
    )


def lenient_verdict(code: Column, language: Column) -> Column:
    """The request's own checks: no minimum length, language compared as it is."""
    return (
        F.when(code.isNull(), "missing code")
        .when(language.isNull(), "missing language")
        .when(F.length(X.trimmed(code)) == 0, "empty code")
        .when(~language.isin(*LANGUAGES), "unsupported language")
    )


def with_verdicts(df: DataFrame, code: str, language: str) -> DataFrame:
    """Adds strict_error, lenient_error and error_code (that of the strict error; null for valid rows)."""
    out = df.withColumn("strict_error", strict_verdict(F.col(code), F.col(language))).withColumn("lenient_error", lenient_verdict(F.col(code), F.col(language)))
    kind = F.when(F.col("strict_error") == "unsupported language", "unsupported language").when(F.col("strict_error").isNotNull(), "validation")
    return out.withColumn("error_code", status_code(kind))


# Status code of each kind of error; any other error is an internal one.
STATUS_CODES = {"invalid code": 400, "unsupported language": 400, "validation": 400, "analysis": 500}


def status_code(kind: Column) -> Column:
    """Status code of a kind of error: null for none, 500 for kinds that are not listed."""
    return F.when(kind.isNotNull(), F.coalesce(*[F.when(kind == k, v) for k, v in STATUS_CODES.items()], F.lit(500)))


@F.pandas_udf(T.BooleanType())
def _python_parses(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in codes:
        yield batch.map(lambda code: None if code is None else python_parses(code))


def simple_syntax(code: Column, language: Column) -> Column:
    """True where the code passes the simple check: Python is parsed, Java always passes, other languages give null, as does
    Python code that the parser can't decide (see functions.syntax)."""
    lang = F.lower(X.trimmed(language))
    return F.when(lang == "python", _python_parses(F.when(lang == "python", code))).when(lang == "java", F.lit(True))
