"""Structured Streaming: gated idempotent loads of landed files, and windows over events (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomspark.operators.upkeep import upsert


def landed(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files as they land in a folder, at most `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


BUCKETS = 64


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")


def _versions(spark: SparkSession, store: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket as the last finished batch (of those before a number) left it; at most a row a bucket."""
    try:
        every = spark.read.schema("bucket int, version int, batch int").parquet(f"{store}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    known = every if before is None else every.where(F.col("batch") < before)
    last = known.agg(F.max("batch").alias("batch")).first()["batch"]
    return {} if last is None else {r["bucket"]: r["version"] for r in known.where(F.col("batch") == last).collect()}


def _rows(spark: SparkSession, store: str, versions: dict[int, int], schema: StructType) -> DataFrame:
    paths = [f"{store}/rows/v{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def keep_latest(stream: DataFrame, store: str, checkpoint: str, key: list[str], order: list[Column], buckets: int = BUCKETS) -> StreamingQuery:
    """Each batch is upserted into a Parquet store (see `latest_rows`); a batch that runs twice gives the same rows.

    Rows lie in `buckets` by a hash of their key. A batch writes only the buckets that it touches, as a
    new version of each, and then the list of all buckets' versions. So a lost batch is written again
    whole, and readers see the last finished one. Upstream deletions don't reach the store (T6).
    """
    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _versions(spark, store, number)
        touched = [r["bucket"] for r in batch.select(_bucket(key, buckets)).distinct().collect()]  # at most `buckets` rows
        old = _rows(spark, store, {b: before[b] for b in touched if b in before}, batch.schema)
        now = upsert(old, batch, key, order)
        now.select("*", _bucket(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/rows/v{number}")
        after = before | {b: number for b in touched}
        if after:
            rows = spark.createDataFrame(sorted(after.items()), "bucket int, version int")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The rows of a store that `keep_latest` keeps, as of its last finished batch."""
    return _rows(spark, store, _versions(spark, store), schema)


def drop_unused(spark: SparkSession, store: str) -> int:
    """Delete the bucket versions that the last finished batch no longer lists; their number. Not while a reader is at work."""
    used = {f"v{v}/bucket={b}" for b, v in _versions(spark, store).items()}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/rows")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for version in fs.listStatus(path) if fs.exists(path) else []:
        for bucket in fs.listStatus(version.getPath()):
            name = f"{version.getPath().getName()}/{bucket.getPath().getName()}"
            if bucket.isDirectory() and name not in used:
                gone += fs.delete(bucket.getPath(), True)
    return gone


def gated(stream: DataFrame, checkpoint: str, complete: Callable[[DataFrame], bool], put: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """T5: a batch is passed on only if it is complete; otherwise the query fails and the batch is asked for again."""
    def gate(batch: DataFrame, number: int) -> None:
        if not complete(batch):
            raise ValueError(f"batch {number} is not complete")
        put(batch, number)

    return stream.writeStream.foreachBatch(gate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and the sum of value by type in windows that don't overlap; rows later than the watermark are dropped when streaming."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "event_type", "n")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions: events closer than `gap`."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")
