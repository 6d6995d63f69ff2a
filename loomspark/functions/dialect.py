"""Expressions that lenient engines give for free and ANSI Spark has to be told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truth_sum(condition: Column) -> Column:
    """Rows for which a condition holds; null if it is null for all."""
    return F.sum(condition.cast("int"))


def prefix_int(text: Column) -> Column:
    """The integer that a text begins with, else 0; null stays null."""
    found = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return F.when(text.isNotNull(), F.coalesce(found, F.lit(0)))


def weekday(date: Column) -> Column:
    """0 for Sunday to 6; null for what is not a date."""
    return F.dayofweek(F.try_to_date(date, "yyyy-MM-dd")) - 1


def duration_minutes(text: Column) -> Column:
    """Minutes of 'Nh MM'."""
    return prefix_int(F.substring_index(text, "h", 1)) * 60 + prefix_int(F.substring_index(text, "h", -1))


def tenor_weight(text: Column) -> Column:
    """Hundredweight of 'cwt-quarters-pounds', as a double."""
    part = lambda k: F.split(text, "-")[k].try_cast("double")
    return part(0) + part(1) / 4.0 + part(2) / 112.0


def band(share: Column, bands: int = 10) -> Column:
    """The band from 0 to bands - 1 of a share from 0 to 1, 1 falling into the last."""
    return F.least(F.floor(bands * share), F.lit(bands - 1))


def tenths(x: Column) -> Column:
    """A double rounded to one decimal as DuckDB does: ten times it to the nearest integer, halves away from 0; `round` takes the digits that it prints."""
    return F.round(x * 10) / 10


def filled(text: Column) -> Column:
    """Neither null nor blank."""
    return text.isNotNull() & (F.trim(text) != "")


def muffled(footnote: Column) -> Column:
    return footnote.ilike("%muffl%")
