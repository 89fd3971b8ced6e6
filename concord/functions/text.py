"""Scalar helpers on names, definitions, numbers and log positions; columns unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.ddl import convert, plain

def rewrite_ddl(ddl: Column) -> Column:
    """Definitions in the other dialect; catalog text, a row for each table, so Python may read it."""

    @F.pandas_udf("string")
    def converted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else convert(x))

    return converted(ddl)


def canonical_ddl(ddl: Column) -> Column:
    """A definition's words without counters, owners, security clauses and charsets; catalog text, too."""

    @F.pandas_udf("string")
    def plainly(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else plain(x))

    return plainly(ddl)


def ignored(line: Column, patterns: list[str]) -> Column:
    """Whether a line of a definition matches one of the patterns that a pair's ignore file lists, one a line."""
    found = F.lit(False)
    for pattern in (p.strip() for p in patterns):
        if pattern and not pattern.startswith("#"):
            found = found | line.rlike(pattern)
    return found


def normalized_expression(expression: Column) -> Column:
    """An expression without white space and case, for comparison."""
    return F.lower(F.regexp_replace(expression, r"[\s()`\"]+", ""))


def redacted(text: Column) -> Column:
    """Passwords in URLs and in key=value text blanked."""
    text = F.regexp_replace(text, r"(://[^:/@\s]+:)[^@\s]+@", "$1***@")
    return F.regexp_replace(text, r"(?i)\b(password|passwd|pwd|secret|token)(\s*[=:]\s*)('[^']*'|\S+)", "$1$2***")


def lsn_number(lsn: Column) -> Column:
    """A log position such as ``0/1F`` as a number that orders like it."""
    high = F.conv(F.element_at(F.split(lsn, "/"), 1), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.element_at(F.split(lsn, "/"), 2), 16, 10).cast("decimal(20,0)")
    return (high * F.lit(4294967296).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def human_count(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(n, 0)


def human_duration(seconds: Column) -> Column:
    """Seconds as 1h02m, 3m04s or 5s."""
    s = F.floor(seconds).cast("long")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s >= 3600, F.concat(hours.cast("string"), F.lit("h"), pad(minutes), F.lit("m"))).when(s >= 60, F.concat(minutes.cast("string"), F.lit("m"), pad(s % 60), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def glob_pattern(pattern: str) -> str:
    """A name pattern with * and ? as a regular expression for the name or an ending of it (plain Python)."""
    import re

    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return rf"(?:^|.*\.){body}$"


def exclusion(name: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """Whether a dotted name falls under one of ``patterns``."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | name.rlike(glob_pattern(pattern))
    return found
