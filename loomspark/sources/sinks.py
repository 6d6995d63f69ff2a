"""Writes: Parquet by parts, CSV with a stated header, JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, parts: list[str] | None = None, append: bool = False) -> None:
    """A snapshot (or an increment) as Parquet, in folders by `parts`; only the parts written are replaced."""
    writer = df.write.mode("append" if append else "overwrite")
    if parts:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, header: list[str]) -> None:
    """A dataset as headed CSV, its columns in a stated order; null as empty, a quote inside a cell doubled."""
    df.select(*header).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def payload(df: DataFrame, name: str) -> DataFrame:
    """A section of a page as JSON, a row at a time."""
    return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("payload"))
