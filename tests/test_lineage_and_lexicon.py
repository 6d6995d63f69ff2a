import pytest
from pyspark.sql import functions as F

from loomspark.operators import lexicon as X
from loomspark.operators import lineage as L


def one(spark, e):
    return spark.range(1).select(e.alias("x")).first()["x"]


@pytest.mark.parametrize("notation,symmetry,changes", [
    ("-16-16-16,12", "palindromic", ["-", "16", "-", "16", "-", "16", "-", "16", "-", "16", "-", "12"]), ("3,1.E.1", None, ["1", "E", "1", "3"]), ("x16x", None, ["-", "16", "-"]), ("", None, []), (None, None, []), ("-12,12", "", ["-", "12", "12"]),
])
def test_changes(spark, notation, symmetry, changes):
    assert one(spark, L.all_changes(F.lit(notation).cast("string"), F.lit(symmetry).cast("string"))) == changes


def test_extensions(spark):
    rows = [
        ("m1", "Plain", 6, "Bob", "palindromic", 1, "1AB", "-16-16-16,12"), ("m2", "Plain", 8, "Bob", "palindromic", 1, "1AB 2CD", "-18-18-18-18,12"), ("m3", "Plain", 8, "Surprise", "palindromic", 1, "9ZZ", "-38-14-1258-36-14-58-16-78,12"),
        ("m4", "Plain", 10, "Bob", "palindromic", 3, None, "-10-10,12"), ("m5", None, 6, "Bob", None, 1, None, "-16,12"), ("m6", "Lone", 6, "Bob", None, 1, None, "-16,12"), ("m7", "Odd", 6, "Bob", "", 1, "x", "34.34.34"), ("m8", "Odd", 8, "Bob", "", 1, "y", "12.1.23.4.5.6.7.8.1.2"),
        ("m9", "Void", 6, None, None, None, None, None), ("m0", "Void", 8, None, None, None, None, "-18"),
    ]
    df = spark.createDataFrame(rows, "method_id string, name string, stage int, classification string, symmetry string, number_of_hunts int, extension_construction string, notation string")
    got = {(r["parent_method_id"], r["child_method_id"]): (r["relationship"], r["confidence"]) for r in L.extensions(df).collect()}
    assert got[("m1", "m2")] == ("extension", "high") and got[("m1", "m3")] == ("name_only", "high") and got[("m1", "m4")] == ("name_only", "high")
    assert got[("m9", "m0")] == ("name_only", "low") and got[("m7", "m8")] == ("name_only", "high")
    assert set(got) == {("m1", "m2"), ("m1", "m3"), ("m1", "m4"), ("m2", "m4"), ("m3", "m4"), ("m7", "m8"), ("m9", "m0")}
    s = L.extension_scores(L.extensions(df)).first()
    assert (s["tp"], s["fp"], s["fn"], s["tn"]) == (1, 0, 0, 2)


@pytest.mark.parametrize("raw,canonical,category", [
    ("S Mary V", "Saint Mary the Virgin", "abbreviation_expansion"), ("Cath Ch of S Paul", "Cathedral Church of Saint Paul", "abbreviation_expansion"), ("SS Peter & Paul", "Saints Peter and Paul", "abbreviation_expansion"), ("All SS", "All Saints", "abbreviation_expansion"),
    ("St Edmund K&M", "Saint Edmund King and Martyr", "abbreviation_expansion"), ("Holy Laurence", "Holy Lawrence", "spelling_variant"), ("  Our Lady ", "Our Lady", "verbatim"), ("H Trinity", "Holy Trinity", "abbreviation_expansion"), ("Peter & Paul", "Peter and Paul", "abbreviation_expansion"),
    ("S Thomas a Becket", "Saint Thomas Becket", "spelling_variant"), ("St Thomas of Canterbury", "Saint Thomas Becket", "alias"), ("Holy Bartholomew", "Holy Bartholomew", "spelling_variant"), ("Botolph", "Botolph", "spelling_variant"),
    ("Edmund K & M", "Edmund King and Martyr", "honorific_expansion"), ("SS Peter & Sts Paul", "Saints Peter and Sts Paul", "abbreviation_expansion"), ("S Mary and St Anne", "Saint Mary and St Anne", "abbreviation_expansion"), ("Sts Cosmas", "Saints Cosmas", "abbreviation_expansion"),
])
def test_dedications(spark, raw, canonical, category):
    got = one(spark, X.apply_rules(F.lit(raw), X.dedication_rules()))
    assert (got["text"], got["category"]) == (canonical, category)


@pytest.mark.parametrize("raw,canonical,category", [("St Albans", "Saint Albans", "abbreviation_expansion"), ("Stratford on Avon", "Stratford-upon-Avon", "toponym_variant"), ("York", "York", "verbatim"), ("South Mymms", "South Mimms", "spelling_variant"), ("King's Lynn,", "Kings Lynn", "punctuation_variant"),
    ("bishop's stortford", "Bishops Stortford", "punctuation_variant"), ("Weston-super-Mare", "Weston-super-Mare", "toponym_variant"), (" Stoke-on-Trent , ", "Stoke-on-Trent", "toponym_variant"), ("St Stow on the Wold", "Saint Stow-on-the-Wold", "toponym_variant")])
def test_places(spark, raw, canonical, category):
    got = one(spark, X.apply_rules(F.lit(raw), X.place_rules(), ", "))
    assert (got["text"], got["category"]) == (canonical, category)


def test_lexicon_pools_domains(spark):
    rows = [("S Mary", "dedication", "a", 1), ("S Mary", "dedication", "b", 2), ("S Mary", "dedication", "c", 3), ("Ely", "dedication", "d", 4), ("Ely ", "place_name", "e", 5), (" ", "place_name", "f", 6), (None, "place_name", "g", 7), ("Helena", "dedication", "h", 8)]
    got = {(r["domain"], r["raw_term"]): r for r in X.lexicon(spark.createDataFrame(rows, "term string, domain string, example string, seq int")).collect()}
    assert (got["dedication", "S Mary"]["evidence_count"], got["dedication", "S Mary"]["source_examples"]) == (3, "a; b") and got["place_name", "Ely"]["evidence_count"] == 2
    assert got["saint_name", "Helena"]["evidence_count"] == 2 and got["saint_name", "Laurence"]["evidence_count"] == 1


@pytest.mark.parametrize("row,accepted", [
    (("St A", "T", "none", "", None, None), False), (("St A", "T", "high", "", 5, None), True), (("St Mary", "Gone", "high", "", 5, None), False), (("Both", "T", "medium", "Dual tower", 5, None), False),
    (("", "T", "medium", "differs from source", 5, "S Mary"), True), (("The Farm", "T", "medium", "differs from source", 5, "S Mary"), False), (("St Mary Magd", "T", "medium", "differs from source", 5, "S Mary Magdalene"), True),
    (("St Paul", "T", "medium", "differs from source", 5, "S Mary"), False), (("St J B", "Strensham", "medium", "differs from source", 5, "S John"), True), (("Dunroamin", "T", "medium", "differs from source", 5, "S Mary"), False),
    (("unknown", "T", "medium", "Partial dedication", 5, None), False), (("St A", "T", "medium", "Partial dedication", 5, None), True), (("Old School", "T", "medium", "Fuzzy place match", 5, None), False), (("St A", "T", "medium", "Fuzzy place match", 5, None), True), (("St A", "T", "medium", "?", 5, None), False),
])
def test_adjudication(spark, row, accepted):
    df = spark.createDataFrame([row], "building string, town string, confidence string, reasoning string, dove_tower_id long, dedication string")
    assert X.adjudicate(df, [("St J B", "Strensham")], [("St Mary", "Gone")]).first()["accepted"] == accepted
