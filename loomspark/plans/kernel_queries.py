"""The permutation kernel on literal methods, with golden rows as oracles."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import kernel as K
from loomspark.operators.search import search
from loomspark.plans.registry import recorded

#: Methods with their stage, notation and lead head.
GOLDEN = (
    ("Plain Bob Minimus", 4, "-14-14,12", "1342"), ("Reverse Bob Minimus", 4, "-14-34,14", "1342"), ("Stedman Doubles", 5, "3.1.5.3.1.3,1", "53412"),
    ("Grandsire Doubles", 5, "3.1.5.1.5.1.5.1.5.1", "12534"), ("Plain Bob Minor", 6, "-16-16-16,12", "135264"), ("Cambridge Surprise Minor", 6, "-36-14-12-36-14-56,12", "156342"),
    ("London Surprise Minor", 6, "36-36.14-12-36.14-14.36,12", "142635"), ("Kent Treble Bob Minor", 6, "34-34.16-12-16-12-16,16", "142635"),
    ("Oxford Treble Bob Minor", 6, "-34-16-12-16-12-16,16", "142635"), ("Stedman Triples", 7, "3.1.7.3.1.3,1", "6347251"), ("Plain Bob Major", 8, "-18-18-18-18,12", "13527486"),
    ("Cambridge Surprise Major", 8, "-38-14-1258-36-14-58-16-78,12", "15738264"), ("Bristol Surprise Major", 8, "-58-14.58-58.36.14-14.58-14-18,18", "14263857"),
    ("Superlative Surprise Major", 8, "-36-14-58-36-14-58-36-78,12", "15738264"), ("Yorkshire Surprise Major", 8, "-38-14-58-16-12-38-14-78,12", "15738264"),
    ("Lincolnshire Surprise Major", 8, "-38-14-58-16-14-58-36-78,12", "15738264"), ("Pudsey Surprise Major", 8, "-58-16-12-38-14-58-16-78,12", "15738264"),
    ("Rutland Surprise Major", 8, "-38-14-58-16-14-38-34-18,12", "14263857"), ("Double Norwich Court Bob Major", 8, "-14-36-58-18,18", "18674523"),
    ("Stedman Caters", 9, "3.1.9.3.1.3,1", "634829175"), ("Plain Bob Royal", 10, "-10-10-10-10-10,12", "1352749608"),
    ("Yorkshire Surprise Royal", 10, "-30-14-50-16-1270-38-14-50-16-90,12", "1573920486"), ("Bristol Surprise Royal", 10, "-50-14.50-50.36.14-70.58.16-16.70-16-10,10", "1352749608"),
    ("Stedman Cinques", 11, "3.1.E.3.1.3,1", "6348201E597"), ("Bristol Surprise Maximus", 12, "-5T-14.5T-5T.36.14-7T.58.16-9T.70.18-18.9T-18-1T,1T", "1795E3T20486"),
    ("Cambridge Surprise Maximus", 12, "-3T-14-125T-36-147T-58-169T-70-18-9T-10-ET,12", "157392E4T608"),
)
_VALUES = ", ".join(f"('{t}', {s}, '{x}', '{h}')" for t, s, x, h in GOLDEN)
MINOR, CALLS = "-16-16-16", {"p": "12", "b": "14", "s": "1234"}
#: The search's method, Cambridge Surprise Major, at eight bells.
MAJOR = "-38-14-1258-36-14-58-16-78"


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GOLDEN, "title string, stage int, notation string, lead_head string")


@recorded(f"SELECT title, lead_head FROM (VALUES {_VALUES}) t(title, stage, notation, lead_head)")
def lead_head(spark: SparkSession, folder: str) -> DataFrame:
    return methods(spark).select("title", K.lead_head(F.col("notation"), F.col("stage")).alias("lead_head"))


@recorded(f"SELECT rule, 26 AS methods, n AS right FROM (VALUES ('mirror_drop_last', 26), ('mirror_full', 1), ('mirror_drop_first', 1), ('b_between', 2)) t(rule, n)")
def expand_rules(spark: SparkSession, folder: str) -> DataFrame:
    return K.rule_scores(methods(spark))


@recorded("SELECT title, rows FROM (VALUES ('Plain Bob Minor', 13), ('Cambridge Surprise Minor', 25)) t(title, rows)")
def lead_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a lead, rounds included."""
    return methods(spark).where(F.col("title").isin("Plain Bob Minor", "Cambridge Surprise Minor")).select("title", F.size(K.lead_rows(F.col("notation"), F.col("stage"))).alias("rows"))


@recorded(f"""WITH m AS (SELECT *, len(regexp_extract_all(split_part(notation, ',', 1), '[-xX]|[^-xX.]+')) AS a, len(regexp_extract_all(split_part(notation, ',', 2), '[-xX]|[^-xX.]+')) AS b FROM (VALUES {_VALUES}) t(title, stage, notation, lead_head))
SELECT title, CASE WHEN b > 0 THEN 2 * a - 1 + b ELSE a END + 1 AS rows FROM m""")
def lead_lengths_all(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a lead, rounds included, of all methods."""
    return methods(spark).select("title", F.size(K.lead_rows(F.col("notation"), F.col("stage"))).alias("rows"))


@recorded("SELECT call, 120 AS heads, 120 AS next_heads FROM (VALUES ('p'), ('b'), ('s')) t(call)")
def course_head_graph(spark: SparkSession, folder: str) -> DataFrame:
    """K9 at six bells: each call leads from the 120 heads to 120 different ones."""
    steps = K.transitions(K.course_heads(spark, 6), MINOR, CALLS, 6)
    return steps.groupBy("call").agg(F.count("*").alias("heads"), F.count_distinct("next_head").alias("next_heads"))


@recorded("SELECT call, 5040 AS heads, 5040 AS next_heads FROM (VALUES ('p'), ('b'), ('s')) t(call)")
def course_head_graph_major(spark: SparkSession, folder: str) -> DataFrame:
    """K9 at eight bells, as searched: each call leads from the 5,040 heads to 5,040 different ones."""
    steps = K.transitions(K.course_heads(spark, 8), MAJOR, CALLS, 8)
    return steps.groupBy("call").agg(F.count("*").alias("heads"), F.count_distinct("next_head").alias("next_heads"))


def composition_search(spark: SparkSession, folder: str, body: str = MINOR, stage: int = 6, least: int = 2, most: int = 12, width: int = 30) -> DataFrame:
    """K13, at six bells if not told otherwise: the paths are replayed row by row in the tests."""
    return search(spark, body, CALLS, stage, least, most, width)


# Recorded at the size of the reference: Cambridge Surprise Major, 39 to 42 leads, beams of 100.
recorded()(wraps(composition_search)(lambda spark, folder: composition_search(spark, folder, MAJOR, 8, 39, 42, 100)))
