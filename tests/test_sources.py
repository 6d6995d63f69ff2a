import json

import pytest
from pyspark.sql import functions as F

from loomspark.sources import readers, sinks, sql_files


@pytest.mark.parametrize("text,count", [
    ("SELECT 1; -- trailing; with a semicolon\nSELECT 2;", 2), ("-- 81% of things don't work\nSELECT 1;", 1), ("SELECT 'a--b' AS x;", 1), ("SELECT 'it''s fine' AS x; -- and; this\nSELECT 2;", 2), ("", 0), (";;", 0), ("SELECT 'never; closed", 1),
])
def test_statements(text, count):
    assert len(sql_files.statements(text)) == count


def test_statement_runs_with_parameters(spark):
    assert sql_files.run(spark, "SELECT 1; SELECT :a + 1 AS x -- more\n", 1, a=4).first()["x"] == 5


def test_csv(spark, tmp_path):
    (tmp_path / "rows_2012.csv").write_text('﻿Tower ID,Place-Name,n,Lat\n1,"A, b",7,1.5\n2,,x,nan\n', encoding="utf-8")
    (tmp_path / "rows_2013.csv").write_text('Tower ID,Place-Name,n,Lat\n2,nan, 8 ,\n', encoding="utf-8")
    got = readers.scan_csv(spark, str(tmp_path / "rows_*.csv"), {"Tower_ID": "long", "Place_Name": "string", "n": "int", "Lat": "double", "missing": "string"})
    assert {tuple(r) for r in got.collect()} == {(1, "A, b", 7, 1.5, None), (2, None, None, None, None), (2, None, 8, None, None)}
    assert {r["Tower_ID"]: r["n"] for r in readers.latest_of(got.where("n IS NOT NULL"), "Tower_ID", "n").collect()} == {1: 7, 2: 8}


METHODS = """<collection xmlns="http://example.org/m"><methodSet><properties><stage>8</stage><classification plain="true" little="false">Bob</classification><lengthOfLead>16</lengthOfLead></properties>
<method id="m1"><title>Plain Bob Major</title><name>Plain</name><notation>-18-18-18-18,12</notation><falseness><fchGroups>B</fchGroups></falseness>
<performances><firstTowerbellPeal><date>1777-01-01</date><location><town> York </town></location></firstTowerbellPeal><firstHandbellPeal><date>1800-01-01</date></firstHandbellPeal></performances></method>
<method id="m2"><title>X</title><name> </name></method></methodSet>
<methodSet><properties><stage>six</stage></properties><method id="m3"><title>Y</title></method></methodSet></collection>"""


def test_methods_xml(spark, tmp_path):
    (tmp_path / "m.xml").write_text(METHODS)
    methods, events = readers.scan_methods(spark, str(tmp_path / "m.xml"))
    got = {r["method_id"]: r for r in methods.collect()}
    assert set(got) == {"m1", "m2", "m3"}
    assert (got["m1"]["stage"], got["m1"]["classification"], got["m1"]["cls_plain"], got["m1"]["cls_little"], got["m1"]["length_of_lead"], got["m1"]["fch_groups"]) == (8, "Bob", 1, 0, 16, "B")
    assert got["m2"]["stage"] == 8 and got["m2"]["name"] is None and got["m3"]["stage"] is None and got["m3"]["cls_plain"] == 0
    assert sorted((r["method_id"], r["event_type"], r["perf_date"], r["town"]) for r in events.collect()) == [("m1", "firstHandbellPeal", "1800-01-01", None), ("m1", "firstTowerbellPeal", "1777-01-01", "York")]


PERFORMANCES = """<performances xmlns="http://example.org/p"><performance id="P12"><association>Guild</association><place dove-tower-id="7" towerbase-id="x"><place-name type="place">York</place-name><place-name type="county">Yorks</place-name>
<ring type="tower" tenor="12-2-13" dove-ring-id="9"/></place><title><changes>5040</changes> <method>Plain Bob</method></title><date>2020-01-02</date><duration>2h 58</duration>
<ringers><ringer bell="1">A B</ringer><ringer bell="2" conductor="true">C D</ringer></ringers><footnote>First</footnote><footnote> </footnote><flag type="first-quarter" bell="1">A B</flag></performance>
<performance id="Pxx"><date>2020-01-02</date></performance><performance id="P13"><date>2020-01-03</date></performance></performances>"""


def test_performances_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PERFORMANCES)
    got = readers.scan_performances(spark, str(tmp_path / "p.xml"))
    rows = {r["perf_id"]: r for r in got["performances"].collect()}
    assert set(rows) == {12, 13}
    r = rows[12]
    assert (r["place"], r["county"], r["dedication"], r["dove_tower_id"], r["towerbase_id"], r["dove_ring_id"], r["ring_type"], r["tenor"], r["changes"], r["method"]) == ("York", "Yorks", None, 7, None, 9, "tower", "12-2-13", 5040, "Plain Bob")
    assert [tuple(x) for x in got["ringers"].orderBy("position").collect()] == [(12, 0, "1", "A B", 0), (12, 1, "2", "C D", 1)]
    assert [tuple(x) for x in got["footnotes"].orderBy("position").collect()] == [(12, 0, "First"), (12, 1, None)]
    assert [tuple(x) for x in got["flags"].collect()] == [(12, 0, "first-quarter", "1", "A B")]


def test_compositions_json(spark, tmp_path):
    rows = [{"id": 5, "title": "No. 1", "opus": "", "stage": 8, "length": "5056", "backstrokeStart": True, "partheads": ["1", "2"], "methodDefinitions": [{"name": "", "title": "Rutland", "rowStage": 8}, {"title": "Kent"}]}, {"id": "x", "length": None}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    compositions, parts = readers.scan_compositions(spark, str(tmp_path / "c.json"))
    c = {r["composition_id"]: r for r in compositions.collect()}
    assert (c[5]["length"], c[5]["opus"], c[5]["backstroke_start"], c[5]["partheads"]) == (5056, None, 1, "1|2") and c[None]["backstroke_start"] == 0
    assert [(r["position"], r["name"], r["method_title"], r["row_stage"]) for r in parts.orderBy("position").collect()] == [(0, None, "Rutland", 8), (1, None, "Kent", None)]
    library = spark.createDataFrame([("m7",)], "method_id string")
    asked = spark.createDataFrame([(1, "7"), (2, "8"), (3, None)], "k int, library_method_id string")
    assert {r["k"]: r["method_id"] for r in readers.known_method_ids(asked, library).collect()} == {1: "m7", 2: None, 3: None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2020), (2, None, 2021)], "id long, name string, year int")
    sinks.write_table(df, str(tmp_path / "t"), ["year"])
    sinks.write_table(df.where("year = 2021").withColumn("name", F.lit("new")), str(tmp_path / "t"), ["year"])
    assert {r["id"]: r["name"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1: "a", 2: "new"}
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"), ["name", "id"])
    assert next((tmp_path / "c").glob("*.csv")).read_text().splitlines() == ["name,id", "a,1", ",2"]
    assert json.loads(sinks.payload(df, "x").where("section = 'x'").first()["payload"])["id"] == 1
