"""Every recorded query against its oracle, and what no oracle covers."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomspark.operators import upkeep as U
from loomspark.plans import pages, registry
from loomspark.plans.bridge import Corpus

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[p]) for p in places) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["d", "n", "base", "ratio"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_seeded_sample_is_stable(spark):
    a = registry.QUERIES["seeded_sample"](spark, SF).collect()
    b = registry.QUERIES["seeded_sample"](spark, SF).collect()
    assert len(a) == 2000 == len({r["o_orderkey"] for r in a}) and a == b


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n.startswith("q")) + ["calendar_anomaly", "co_occurrence_pairs", "window_gate"])
def test_no_plan_compares_every_row_with_every_other(spark, name):
    df = registry.QUERIES[name](spark, SF)
    faults = U.plan_faults(df)
    single = name in ("q13_debut_denominators", "q20_footnote_denominators", "q24_muffled_base_rate", "q31_linkage_coverage", "q44_muffled_overall")
    assert not faults or single  # one row beside one row


def test_filters_and_columns_reach_the_scan(spark):
    plan = Corpus(spark, SF).methods.select("method_id", "stage").where("stage = 4")._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan
    plan = registry.QUERIES["pricing_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan and "l_extendedprice" not in plan


def test_missing_tables(spark):
    spark.range(1).createOrReplaceTempView("here")
    assert U.missing_tables(spark, ["here", "gone", "perhaps"], ("perhaps",)) == [("gone", "FAIL"), ("perhaps", "SKIP")]


@pytest.mark.parametrize("name", ["debut_places", "debut_batch_days"])
def test_debuts_that_tie_take_the_first_row(spark, tmp_path, name):
    """One thread of DuckDB keeps the first of rows that tie; methods tie inside a file and across files."""
    (tmp_path / "lineitem.parquet").mkdir()
    con = duckdb.connect(config={"threads": 1})
    for k, flags in enumerate(("ARRN", "RNNA", "NAAR")):
        rows = f"SELECT 1 + 58 * i AS l_orderkey, CAST(m + 40 * ({k} // 2) AS BIGINT) AS l_partkey, 15 AS l_suppkey, CASE WHEN m % 5 < 4 THEN 1 END AS l_linenumber, '{flags}'[1 + i] AS l_returnflag, TIMESTAMP '1999-02-03' + to_days(CAST(m % 7 AS INT)) AS l_shipdate"
        con.execute(f"COPY (SELECT * REPLACE (CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_suppkey AS BIGINT) AS l_suppkey) FROM ({rows} FROM range(60) a(m), range(4) b(i) ORDER BY i, m)) TO '{tmp_path}/lineitem.parquet/part-{k}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in found.fetchall())


def test_a_mean_on_a_half_hangs_on_no_order_of_rows(spark):
    """The plain sum of the first as doubles is a little less than that of the second."""
    for shares in ([12.3, 12.1, 19.2, 11.4], [11.4, 12.3, 12.1, 19.2]):
        rows = spark.createDataFrame([(300, 1, x) for x in shares], "total_weekday long, is_busiest int, stated_night_pct double").coalesce(1)
        assert [tuple(r) for r in pages.by_tier(rows).collect()] == [("200+", 4, 100.0, 13.8)]
