import datetime
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark import schemas
from loomspark.functions import dialect as D
from loomspark.operators import analytics as A
from loomspark.operators import calendar as C
from loomspark.operators import upkeep as U
from loomspark.operators import views as V


def one(spark, e):
    return spark.range(1).select(e.alias("x")).first()["x"]


@pytest.mark.parametrize("text,n", [("21 mins", 21), ("", 0), ("  -7x", -7), ("x", 0), (None, None), ("99999999999999999999", 0)])
def test_prefix_numbers(spark, text, n):
    assert one(spark, D.prefix_int(F.lit(text).cast("string"))) == n


def test_measures(spark):
    assert one(spark, D.tenor_weight(F.lit("12-1-14"))) == 12.375
    assert one(spark, D.duration_minutes(F.lit("3h 07"))) == 187
    assert [one(spark, D.weekday(F.lit(d))) for d in ("2024-01-07", "2024-01-08", "1777", "x")] == [0, 1, None, None]
    assert [one(spark, D.band(F.lit(x))) for x in (0.0, 0.1, 0.99, 1.0)] == [0, 1, 9, 9]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=30), st.sampled_from([0, 10, 25, 50, 75, 100]))
def test_nearest_rank(spark, values, p):
    got = A.nearest_rank(spark.createDataFrame([(v,) for v in values], "v int"), [], "v", [p]).first()["value"]
    assert got == sorted(values)[round(p / 100 * (len(values) - 1))]


def test_baseline_by_hand(spark):
    day = datetime.date(2024, 1, 1)
    counts = {day + datetime.timedelta(k): 1 + k % 7 + (40 if k == 45 else 0) for k in range(90)}
    rows = [(d,) for d, n in counts.items() for _ in range(n)]
    days = C.daily_counts(spark.createDataFrame(rows, "d date"), "d")
    assert {r["d"]: r["n"] for r in days.collect()} == counts
    found = C.anomalies(days, 3.5, 40).collect()
    assert [r["d"] for r in found] == [day + datetime.timedelta(45)] and found[0]["base"] == 1 + 45 % 7
    assert C.anomalies(C.daily_counts(spark.createDataFrame([], "d date"), "d")).count() == 0


def test_feasts(spark):
    years = spark.createDataFrame([(2021,), (2022,), (2023,), (2024,)], "year int")
    assert sorted(str(r["d"]) for r in C.second_sunday_of_november(years).collect()) == ["2021-11-14", "2022-11-13", "2023-11-12", "2024-11-10"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, None, "c")], "k int, seq int, v string")
    new = spark.createDataFrame([(2, 5, "B"), (1, 4, "late"), (4, 1, None)], "k int, seq int, v string")
    assert {r["k"]: r["v"] for r in U.upsert(old, new, ["k"], [F.col("seq")]).collect()} == {1: "a", 2: "B", 3: "c", 4: None}
    again = U.upsert(U.upsert(old, new, ["k"], [F.col("seq")]), new, ["k"], [F.col("seq")])
    assert {r["k"]: r["v"] for r in again.collect()} == {1: "a", 2: "B", 3: "c", 4: None}


def test_gates_fail_on_missing_and_on_repeated_rows(spark):
    spans = U.windows("2024-01-01", "2024-01-10", 4, spark)
    assert [(str(r["begins"]), str(r["ends"])) for r in spans.orderBy("begins").collect()] == [("2024-01-01", "2024-01-04"), ("2024-01-05", "2024-01-08"), ("2024-01-09", "2024-01-10")]
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-04", 2), ("2024-01-05", 3), ("2024-01-05", 3)], "d string, k int")
    expected = spark.sql("SELECT DATE'2024-01-01' AS begins, 2L AS expected UNION ALL SELECT DATE'2024-01-05', 1L UNION ALL SELECT DATE'2024-01-09', 1L")
    assert [r["complete"] for r in U.window_gate(rows, "d", "k", expected, spans).orderBy("begins").collect()] == [True, False, False]


def test_staged_update_takes_nulls_as_equal(spark):
    target = spark.createDataFrame([("a", None, 1), ("b", "x", 2), (None, None, 3)], "p string, q string, v int")
    source = spark.createDataFrame([("a", None, 10), (None, None, 30)], "p string, q string, v int")
    assert sorted((r["p"] or "", r["v"]) for r in U.staged_update(target, source, ["p", "q"], "v").collect() if r["v"]) == [("", 30), ("a", 10)]


def test_compositions_keep_methods_the_library_lacks(spark):
    got = V.composition_methods_view(spark.createDataFrame([(1, "t")], "composition_id int, title string"), spark.createDataFrame([(1, "m1"), (1, "m9"), (2, "m1")], "composition_id int, method_id string"), spark.createDataFrame([("m1", "One")], "method_id string, title string"))
    assert {(r["method_id"], r["library_title"]) for r in got.collect()} == {("m1", "One"), ("m9", None)}


def test_schemas(spark, tmp_path):
    assert len(schemas.COLUMNS) == 17 and {t: len(schemas.schema(t)) for t in ("bells", "dove", "towers", "performances", "methods", "compositions")} == {"bells": 31, "dove": 48, "towers": 48, "performances": 23, "methods": 21, "compositions": 18}
    assert all(set(k) <= set(schemas.schema(t).names) for t, k in schemas.KEYS.items())
    (tmp_path / "p.csv").write_text("perf_id,towerbase-id,perf_date,changes\n7,3,2020-01-01,\n8,,,5040\n")
    got = schemas.load_csv(spark, "performances", str(tmp_path / "p.csv"))
    assert got.schema == schemas.schema("performances") or got.columns == schemas.schema("performances").names
    assert [(r["perf_id"], r["towerbase-id"], r["perf_date"], r["changes"]) for r in got.orderBy("perf_id").collect()] == [(7, 3, "2020-01-01", None), (8, None, None, 5040)]


@pytest.mark.parametrize("parts", [1, 8])
def test_results_do_not_depend_on_partitions(spark, parts):
    from loomspark.plans import registry

    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        seen = {name: hashlib.md5(repr(sorted(map(str, registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))).encode()).hexdigest() for name in ("q45_ringing_careers", "top_partners", "nearest_rank_percentiles", "event_labels")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert seen == _first.setdefault("seen", seen)


_first: dict = {}


def test_co_occurrence_by_blocks_gives_all_pairs(spark):
    import random
    from collections import Counter
    from itertools import combinations

    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 60)) for _ in range(600)]
    places = {}
    for p, m in rows:
        places.setdefault(p, set()).add(m)
    want = Counter(pair for own in places.values() for pair in combinations(sorted(own), 2))
    df = spark.createDataFrame(rows, "p int, m int")
    for block in (4, 1024):
        got = {(r["a"], r["b"]): r["n"] for r in A.co_occurrence(df, "p", "m", 2, block).collect()}
        assert got == {k: n for k, n in want.items() if n >= 2}


def test_windows_keep_their_state(spark):
    day = datetime.date
    gate = spark.createDataFrame([(day(2024, 1, 1), day(2024, 1, 7), 5, 5, True), (day(2024, 1, 8), day(2024, 1, 14), 5, 4, False), (day(2024, 1, 15), day(2024, 1, 21), 5, 0, False)], "begins date, ends date, expected long, rows long, complete boolean")
    state = U.window_state(gate)
    assert [r["status"] for r in state.orderBy("begins").collect()] == ["completed", "failed", "pending"]
    assert [r["begins"] for r in U.windows_to_ask(state).collect()] == [day(2024, 1, 8), day(2024, 1, 15)]
    worse = gate.withColumn("complete", F.lit(False))
    assert [r["status"] for r in U.window_state(worse, state).orderBy("begins").collect()] == ["completed", "failed", "pending"]
    assert [r["status"] for r in U.window_state(worse, state.withColumn("version", F.lit(1))).orderBy("begins").collect()] == ["failed", "failed", "pending"]
