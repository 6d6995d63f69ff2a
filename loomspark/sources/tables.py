"""Reading the Parquet tables of a data folder, with their columns pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`: one Parquet file or a folder of them, by any path that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The table over all task slots, if its files give fewer tasks than there are slots; else as it is.

    A small file of one row group would otherwise keep a single core busy. A large input has more splits than slots, so nothing is dealt out.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df._jdf.queryExecution().toRdd().getNumPartitions() < slots else df
