"""Cutting lineage so that a lost executor costs a reread and not a recomputation."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of `stored`: a task holds one of those that it writes and one of those that it reads, whatever its share of the rows.
ROW_GROUP = 8 << 20


def _shared(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It is in spark.checkpoint.dir, which all executors share. Only a local
    session without that setting (as in tests) gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomspark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and go on from the copy."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder of its own under the checkpoint folder, which all executors share."""
    return f"{_shared(spark)}/{name.replace(' ', '_')}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to a folder of its own under the checkpoint folder, where it stays, and read it again.

    Its row groups are of about ROW_GROUP bytes.
    """
    path = f"{scratch(df.sparkSession, name)}.parquet"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
