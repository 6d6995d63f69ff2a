"""Contiguous shards of near equal bytes, from global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.materialize import settle
from loomspark.llm.ordering import RANGE, into_ranges

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def shard_by_bytes(docs: DataFrame, shards: int = 8, whole_share: float = 0.01) -> DataFrame:
    """Put every row of `docs` (doc_id, text) into one of `shards` contiguous shards of near equal bytes.

    The rows get one global order, by a hash of the text and then doc_id, so equal texts are
    neighbours. Sizes are UTF-8 bytes plus 1. The prefix sum of a row is that of its range, from
    the totals of all ranges, plus the running sum inside the range. The cuts stand at equal
    targets; one that falls inside a group of equal texts of at most `whole_share` of a target
    moves to the nearer end of the group, so small groups stay whole and large ones are split.

    On the driver: one total a range (as many as shuffle partitions) and a row for each cut.
    Null text: as empty. Null doc_id: a row like any other, first among equal texts. Repeated
    rows: each has its own place. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = settle(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    ))
    ranged = into_ranges(thin, [F.col("text_hash"), F.col("doc_id")])
    totals = ranged.groupBy(RANGE).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy(RANGE).collect()
    if not totals:
        return spark.createDataFrame([], SCHEMA)
    before, byte, row = [], 0, 0
    for t in totals:
        before.append((t[RANGE], byte, row))
        byte, row = byte + t["bytes"], row + t["rows"]
    inside = Window.partitionBy(RANGE).orderBy("text_hash", "doc_id")
    placed = settle(
        ranged.join(F.broadcast(spark.createDataFrame(before, f"{RANGE} int, bytes_before long, rows_before long")), RANGE)
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
        .select("doc_id", "size", "text_crc32", "text_hash", "start", "place")
    )
    cuts = _cuts(placed, byte, shards, whole_share)
    shard = sum(((F.col("start") >= c).cast("int") for c in cuts), F.lit(0))
    first = {r["shard"]: r["place"] for r in placed.groupBy(shard.alias("shard")).agg(F.min("place").alias("place")).collect()}
    start_of = F.element_at(F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(shards)]), F.col("shard") + 1)
    return (
        placed.withColumn("shard", shard)
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("place") - start_of).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _cuts(placed: DataFrame, total: int, shards: int, whole_share: float) -> list[int]:
    """Byte offsets at which shards 1, 2, ... begin; a row belongs after each cut at or before its start."""
    aims = [total * k // shards for k in range(1, shards)]
    if not aims:
        return []
    end = F.col("start") + F.col("size")
    at = F.lit(False)
    for a in aims:
        at = at | ((F.col("start") <= a) & (end > a))
    across = placed.where(at).select("text_hash", "start", end.alias("end")).collect()
    keys = [r["text_hash"] for r in across]
    groups = {
        r["text_hash"]: r
        for r in placed.where(F.col("text_hash").isin(keys)).groupBy("text_hash").agg(F.min("start").alias("start"), F.max(end).alias("end")).collect()
    }
    cuts = []
    for a in aims:
        row = next(r for r in across if r["start"] <= a < r["end"])
        group = groups[row["text_hash"]]
        span = group if group["end"] - group["start"] <= whole_share * total / shards else row
        cuts.append(span["start"] if a - span["start"] <= span["end"] - a else span["end"])
    return cuts
