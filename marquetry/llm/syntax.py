"""Source files that do not parse: a verdict per record, rates per owner and language.

Every text is ranked over the supported languages by its tokens and then parsed by all of their grammars, the likeliest first.
The declared language's grammar decides whether the text is valid; where it fails, a foreign parse that succeeds names a wrong
extension, and failure of all grammars means that the text is corrupt. A text that a parser gives up on by a limit of its own
is undecided and never reported as invalid.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.functions import syntax
from marquetry.functions.text import trimmed
from marquetry.llm.java_grammar import java_parses


def python_parses(text: str) -> bool | None:
    """functions.syntax.python_parses, with a leading byte order mark allowed, as in files."""
    return syntax.python_parses(text.removeprefix("\ufeff"))


GRAMMARS: dict[str, Callable[[str], bool | None]] = {"python": python_parses, "java": java_parses}
# Tokens that speak for a language. They order the grammars only; every one of them is tried on every text.
CUES = {
    "python": re.compile(r"^\s*(?:def|class|elif|except|import|from|with)\b[^;{]*$|:\s*$|\bself\b|\bNone\b", re.M),
    "java": re.compile(r"[;{}]\s*$|\b(?:public|private|static|void|new|final)\b", re.M),
}


def ranked(text: str) -> list[str]:
    """Supported languages, the most likely first; equal counts keep the order of GRAMMARS."""
    return sorted(GRAMMARS, key=lambda g: -len(CUES[g].findall(text)))


def judge(text: str, declared: str) -> tuple[bool | None, str, str | None, str | None]:
    """(valid, verdict, language it parses as, other languages it also parses as, comma-separated).

    valid is null where the declared language's parser gives up. The verdict is undecided there, and for an invalid text that no
    other grammar accepts while another parser gives up; else it is ok, wrong_extension or corrupt."""
    order = ranked(text)
    parses = {g: GRAMMARS[g](text) for g in order}
    foreign = [g for g in order if g != declared and parses[g]]
    also = ",".join(foreign) or None
    if parses[declared]:
        return True, "ok", declared, also
    if parses[declared] is None:
        return None, "undecided", None, also
    if foreign:
        return False, "wrong_extension", foreign[0], ",".join(foreign[1:]) or None
    return False, "corrupt" if None not in parses.values() else "undecided", None, None


_SCHEMA = "record_id string, owner string, declared string, valid boolean, verdict string, parses_as string, also_parses_as string"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    types = [pa.bool_() if c.endswith("boolean") else pa.string() for c in _SCHEMA.split(", ")]
    for b in batches:
        rows = []
        for i, owner, declared, text in zip(*(c.to_pylist() for c in b.columns)):
            if text.strip():
                rows.append((i, owner, declared, *judge(text, declared)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in zip(types, zip(*rows) if rows else [[]] * len(types))], names=names)


def verdicts(df: DataFrame) -> DataFrame:
    """record_id, owner, declared, valid, verdict, parses_as, also_parses_as of records whose declared language is supported.

    df: id, owner, declared (letter case and outer blanks ignored), text. Null ids, null and blank texts and other declared
    languages are not judged and give no row; repeated rows of an id give one. Extra columns are ignored. One pass over the
    scan: only the narrow result is exchanged.
    """
    known = df.select("id", "owner", F.lower(trimmed(F.col("declared"))).alias("declared"), "text").filter(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("declared").isin(*GRAMMARS))
    return known.mapInArrow(_judged, _SCHEMA).dropDuplicates(["record_id"])


def rates(v: DataFrame) -> DataFrame:
    """Per owner (null: unknown) and declared language: files, invalid, wrong_extension, corrupt, undecided, invalid_percent."""
    one = lambda x: F.count_if(F.col("verdict") == x).alias(x)
    out = v.groupBy("owner", F.col("declared").alias("language")).agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), one("wrong_extension"), one("corrupt"), one("undecided"))
    return out.withColumn("invalid_percent", F.round(F.col("invalid") * 100.0 / F.col("files"), 2))
