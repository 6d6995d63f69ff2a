"""A global order over all rows without a global task: ranges, then totals of the ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.materialize import settle

RANGE = "range_no"


def into_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Deal the rows into contiguous ranges of `order`, numbered upwards in RANGE, and settle them.

    As many ranges as spark.sql.shuffle.partitions. The order should end in a column that tells
    equal keys apart, so that one key with a third of all rows spreads over several ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id()))
