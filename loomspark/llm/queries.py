"""The registered queries of this subpackage and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import audio, chat, html, licenses, mixing, packing, quality, rules, sharding, simhash
from loomspark.sources.tables import spread, table


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", *columns))


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, folder))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(documents(spark, folder))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(spread(table(spark, folder, "pages")))


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest_conversations(rows.union(more))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, folder))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.component_ids(documents(spark, folder))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder, "source")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.with_score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_audio(spark: SparkSession, folder: str) -> DataFrame:
    made = audio.audio_columns(documents(spark, folder))
    payload = F.substring("media", audio.HEADER + 1, 2147483647)
    return made.withColumn("payload", payload).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_packing, op4_html, op5_chat, op6_sharding, op7_simhash, op8_mixing, op9_quality, op10_audio)}

ORACLES = {
    "op8_mixing": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s
), x AS (
  SELECT source, source_size, rank, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS room FROM w
), y AS (
  SELECT *,
    (CAST((SELECT sum(source_size) FROM s) AS BIGINT)
      - CAST(coalesce(sum(room) OVER (ORDER BY room / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
      / CAST(sum(weight) OVER (ORDER BY room / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM x
), z AS (
  SELECT source, source_size,
    least(CAST(room AS DOUBLE), (SELECT max(level) FROM y WHERE level * weight <= room) * weight) AS target,
    CAST(CAST('0x' || md5('17:' || coalesce('s' || source, 'n'))[1:8] AS BIGINT) AS DOUBLE) / 4294967296.0 AS offset_
  FROM y
), r AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id DESC NULLS LAST) AS place FROM d
), f AS (
  SELECT source, CAST(0 AS BIGINT) AS place, target AS left_, source_size AS size_left, offset_ AS total, CAST(0 AS BIGINT) AS n FROM z
  UNION ALL
  SELECT source, place, left_ - CAST(n * size AS DOUBLE), size_left - size, total + e, n
  FROM (
    SELECT *, CAST(floor(total + e) - floor(total) AS BIGINT) AS n
    FROM (
      SELECT f.source, r.place, f.left_, f.size_left, f.total, r.size,
        CASE WHEN r.size > 0 THEN least(3.0::DOUBLE, greatest(0.0::DOUBLE, ceil((f.left_ - 3 * (f.size_left - r.size)) / r.size), least(f.left_ / f.size_left, floor(f.left_ / r.size)))) ELSE 0.0::DOUBLE END AS e
      FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source AND r.place = f.place + 1
      WHERE f.place < 512
    )
  )
), g AS (
  SELECT source, last(left_ ORDER BY place) AS left_, last(size_left ORDER BY place) AS size_left, last(total ORDER BY place) AS total FROM f GROUP BY source
), h AS (
  SELECT source, total, CASE WHEN size_left > 0 THEN greatest(0.0, least(3.0, left_ / size_left)) ELSE 0.0 END AS e FROM g
), k AS (
  SELECT r.doc_id, r.size, z.source_size, z.target,
    CASE WHEN r.place <= 512 THEN f.n ELSE CAST(floor((r.place - 512) * h.e + h.total) - floor((r.place - 513) * h.e + h.total) AS BIGINT) END AS copies
  FROM r JOIN z ON r.source IS NOT DISTINCT FROM z.source JOIN h ON r.source IS NOT DISTINCT FROM h.source
  LEFT JOIN f ON r.source IS NOT DISTINCT FROM f.source AND r.place = f.place
)
SELECT doc_id, size, source_size, target, copies * size AS taken FROM k
""",
}
