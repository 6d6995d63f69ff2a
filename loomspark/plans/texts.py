"""Classifiers on the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import analytics as A
from loomspark.operators import classify as K
from loomspark.plans.bridge import Corpus, oracle
from loomspark.plans.registry import recorded
from loomspark.sources.tables import table

#: Words of the documents that stand for occasions there.
THEMES = {"license": r"(?i)\b(license|licensed)\b", "quiet": r"(?i)\bthe the\b", "shout": "!!", "grid": r" \| ", "worth": r"(?i)\b(stupid|worthless)\b"}
_FLAGS = ", ".join(f"regexp_matches(coalesce(text, ''), '{p}') AS {k}" for k, p in THEMES.items())
_LONG = f"l AS (SELECT doc_id, {_FLAGS} FROM documents), u AS (UNPIVOT l ON {', '.join(THEMES)} INTO NAME label VALUE hit)"


def _themes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", K.labels(F.col("text"), THEMES).alias("labels"))


@recorded(f"WITH {_LONG} SELECT label, count(*) AS n FROM u WHERE hit GROUP BY label")
def occasion_multilabel(spark: SparkSession, folder: str) -> DataFrame:
    return K.label_counts(_themes(spark, folder))


@recorded(f"WITH {_LONG} SELECT a.label AS a, b.label AS b, count(*) AS n FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.label < b.label WHERE a.hit AND b.hit GROUP BY 1, 2")
def overlap_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return K.label_pairs(_themes(spark, folder))


@recorded(f"WITH {_LONG}, s AS (SELECT doc_id, sum(CAST(hit AS INT)) AS k FROM u GROUP BY 1) SELECT count(*) AS rows, count(*) FILTER (WHERE k = 0) AS unclassified, count(*) FILTER (WHERE k > 1) AS multi FROM s")
def label_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return K.label_coverage(_themes(spark, folder))


@recorded("""
WITH g AS (SELECT quality = 0 AS t, regexp_matches(text, '!!| \\| |[#$%&*]{3}') AS g FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn, count(*) FILTER (WHERE NOT t AND NOT g) AS tn FROM g)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c""")
def classifier_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A pattern's guess at low quality against the labels."""
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    guess = F.col("text").rlike(r"!!| \| |[#$%&*]{3}").cast("int")
    return A.scores(rows.select((F.col("quality") == 0).cast("int").alias("t"), guess.alias("g")), "t", "g")


@recorded(oracle("""
SELECT label AS practice, count(*) AS n FROM (SELECT CASE WHEN method ILIKE '%toll%' THEN 'tolling' WHEN method ILIKE '%call changes%' THEN 'call_changes' ELSE 'unclassified' END AS label FROM performances) GROUP BY 1""", "performances"))
def practice_label(spark: SparkSession, folder: str) -> DataFrame:
    """K-T1 over the bridged performances."""
    return Corpus(spark, folder).performances.groupBy(K.practice(F.col("method")).alias("practice")).agg(F.count("*").alias("n"))


@recorded(oracle("""
WITH t AS (SELECT CAST(regexp_extract(method, '(?i)^\\s*(\\d{1,3})\\s+(?:half[- ]muffled\\s+)?tolling\\s*$', 1) AS INT) AS tolls, perf_date AS d FROM performances WHERE regexp_matches(method, '(?i)^\\s*(\\d{1,3})\\s+(?:half[- ]muffled\\s+)?tolling\\s*$')),
c AS (SELECT tolls, d, count(*) AS n FROM t GROUP BY ALL)
SELECT tolls, CAST(sum(n) AS BIGINT) AS n, count(*) AS days, (SELECT d FROM c x WHERE x.tolls = c.tolls ORDER BY n DESC, d LIMIT 1) AS modal_day FROM c GROUP BY tolls""", "performances"))
def counted_tolls(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, days and modal day of each counted toll."""
    tolls = Corpus(spark, folder).performances.select(K.toll_count(F.col("method")).alias("tolls"), F.col("perf_date").alias("d")).where("tolls IS NOT NULL")
    counts = tolls.groupBy("tolls", "d").agg(F.count("*").alias("k"))
    return counts.groupBy("tolls").agg(F.sum("k").alias("n"), F.count("*").alias("days"), F.min_by("d", F.struct(-F.col("k"), "d")).alias("modal_day"))


@recorded(oracle("""
SELECT CASE WHEN footnote ILIKE '%the fallen%' THEN 'civic' WHEN footnote ILIKE '%muffled%' THEN 'memorial' WHEN footnote ILIKE '%wedding%' THEN 'wedding' WHEN footnote ILIKE 'first quarter%' THEN 'first-performance' ELSE 'none' END AS occasion,
  CASE WHEN footnote ILIKE '%the fallen%' THEN 'institution' WHEN footnote ILIKE '%muffled%' OR footnote ILIKE '%wedding%' THEN 'person' ELSE 'none' END AS subject, count(*) AS n FROM performance_footnotes GROUP BY ALL""", "performance_footnotes"))
def footnote_occasions(spark: SparkSession, folder: str) -> DataFrame:
    """K-T2 over the bridged footnotes."""
    found = Corpus(spark, folder).performance_footnotes.select(K.occasion(F.col("footnote")).alias("o"))
    return found.groupBy("o.occasion", "o.subject").agg(F.count("*").alias("n"))
