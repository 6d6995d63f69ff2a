import pytest
from pyspark.sql import functions as F

from loomspark.operators import classify as K

@pytest.mark.parametrize("text,label", [
    ("3m Doubles", "multiple_methods"), ("99 Single Bell Tolling", "tolling"), ("Call Changes and Rounds", "rounds_and_call_changes"), ("Callchanges", "call_changes"), ("C.C.s", "call_changes"),
    ("Rounds", "rounds"), ("April Day Doubles", "unclassified"), ("Cambridge and PB Minor", "multiple_methods"), ("Service Ringing", "general"), (None, "unclassified"),
])
def test_practice(spark, text, label):
    assert spark.range(1).select(K.practice(F.lit(text).cast("string")).alias("x")).first()["x"] == label


@pytest.mark.parametrize("text,occasion,subject", [
    ("", "none", "none"), (None, "none", "none"), ("Half-muffled for John Smith", "memorial", "person"), ("For the funeral of Her Majesty the Queen", "civic", "person"), ("Rung for Armistice, lest we forget", "civic", "institution"),
    ("Happy 70th birthday Ann", "birthday", "person"), ("Golden wedding", "wedding", "person"), ("Centenary of the bells", "anniversary", "bells"), ("Centenary of the Guild", "anniversary", "institution"), ("For evensong", "seasonal", "none"),
    ("Congratulations to the new vicar", "compliment", "person"), ("First quarter: 3", "first-performance", "none"), ("First quarter on the new bells", "first-performance", "bells"), ("Practice night", "practice", "none"), ("Nothing special", "none", "none"),
])
def test_occasions(spark, text, occasion, subject):
    got = spark.range(1).select(K.occasion(F.lit(text).cast("string")).alias("x")).first()["x"]
    assert (got["occasion"], got["subject"]) == (occasion, subject)


@pytest.mark.parametrize("building,town,kind", [
    ("St Mary", "Ely", "tower"), (None, "Ely", "tower"), ("", "Ringing Room", "virtual"), ("NB Swift", "Ely", "vessel"), ("12 Example Street", "Ely", "address"), ("Rose Cottage", "Ely", "house"), ("Church Lane, St Mary", "Ely", "tower"), ("Swaledale", "Ely", "private ring"),
])
def test_venues(spark, building, town, kind):
    assert spark.range(1).select(K.venue(F.lit(building).cast("string"), F.lit(town)).alias("x")).first()["x"] == kind


@pytest.mark.parametrize("text,n", [("99 Tolling", 99), ("96 Half Muffled Tolling", 96), ("96 half-muffled tolling", 96), ("Tolling", None), ("1000 Tolling", None), ("9 Tolling x", None), (None, None)])
def test_tolls(spark, text, n):
    assert spark.range(1).select(K.toll_count(F.lit(text).cast("string")).alias("x")).first()["x"] == n


def test_labels_and_novelty(spark):
    df = spark.createDataFrame([("A birthday and a wedding",), ("nothing",), (None,)], "t string").select(K.labels(F.col("t"), K.OCCASIONS).alias("labels"))
    assert {r["label"]: r["n"] for r in K.label_counts(df).collect()} == {"birthday": 1, "wedding": 1}
    assert [tuple(r) for r in K.label_pairs(df).collect()] == [("birthday", "wedding", 1)]
    assert tuple(K.label_coverage(df).first()) == (3, 2, 1)
    known = spark.createDataFrame([("p p b",), ("x p, p, b y",), ("ppb",), (None,)], "details string")
    assert tuple(K.novelty(known, "ppb").first()) == (2, False) and K.novelty(known, "bbb").first()["novel"]
