"""Recorded SQL: files of statements, found by place, run with named parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: A string, in which a doubled quote is one; a comment to the line's end; a divider.
_TOKEN = re.compile(r"'(?:[^']|'')*(?:'|\Z)|--[^\n]*|;")


def statements(text: str) -> list[str]:
    """The statements of a text without comments; semicolons and dashes inside strings are data."""
    out, begin, now = [], 0, []
    for m in _TOKEN.finditer(text):
        if m[0][0] == "'":
            continue
        now.append(text[begin : m.start()])
        begin = m.end()
        if m[0] == ";":
            out.append("".join(now))
            now = []
    out.append("".join([*now, text[begin:]]))
    return [s.strip() for s in out if s.strip()]


def run(spark: SparkSession, text: str, place: int = 0, **args: object) -> DataFrame:
    """The statement at a place, with its named parameters bound."""
    return spark.sql(statements(text)[place], args=args)
