"""Integrity checks and incremental loads on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import upkeep as U
from loomspark.operators import views as V
from loomspark.plans.bridge import Corpus, oracle
from loomspark.plans.registry import recorded
from loomspark.sources.tables import table


@recorded("SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS most FROM lineitem")
def fanout_report(spark: SparkSession, folder: str) -> DataFrame:
    return U.fan_out(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@recorded(oracle("SELECT dove_tower_id, count(*) AS n FROM performances WHERE dove_tower_id NOT IN (SELECT TowerID FROM towers) GROUP BY 1", "performances", "towers"))
def orphan_keys(spark: SparkSession, folder: str) -> DataFrame:
    c = Corpus(spark, folder)
    return U.orphans(c.performances, "dove_tower_id", (c.towers_unique, "TowerID"), (c.dove, "TowerID")).groupBy("dove_tower_id").agg(F.count("*").alias("n"))


@recorded(oracle("""WITH parents AS (SELECT 'unique' AS parent, TowerID AS t FROM towers_unique UNION ALL SELECT 'rings', TowerID FROM towers),
j AS (SELECT parent, count(*) AS joined FROM performances JOIN parents ON t = dove_tower_id GROUP BY parent),
c AS (SELECT count(dove_tower_id) AS linked, count(*) FILTER (WHERE dove_tower_id NOT IN (SELECT TowerID FROM towers)) AS orphaned FROM performances)
SELECT parent, linked, orphaned, joined, joined = linked - orphaned AS holds FROM c, j""", "performances", "towers_unique"))
def join_identity(spark: SparkSession, folder: str) -> DataFrame:
    """The projection of one row a tower holds, the register of rings fans out and does not."""
    c = Corpus(spark, folder)
    one = lambda name, parent: U.join_identity(c.performances, "dove_tower_id", parent, "TowerID").select(F.lit(name).alias("parent"), "linked", "orphaned", "joined", "holds")
    return one("unique", c.towers_unique).union(one("rings", c.towers))


_CELLS = "SELECT CASE WHEN p_partkey % 10 = 0 THEN 'NaN' ELSE p_name END AS p_name, CASE WHEN p_partkey % 7 = 0 THEN ' nan ' WHEN p_partkey % 7 = 1 THEN NULL ELSE p_brand END AS p_brand, p_type, p_size FROM {part}"


@recorded(f"WITH t AS ({_CELLS.format(part='part')}) SELECT c AS column, n FROM (UNPIVOT (SELECT count(*) FILTER (WHERE lower(trim(p_name)) = 'nan') AS p_name, count(*) FILTER (WHERE lower(trim(p_brand)) = 'nan') AS p_brand, count(*) FILTER (WHERE lower(trim(p_type)) = 'nan') AS p_type FROM t) ON p_name, p_brand, p_type INTO NAME c VALUE n)")
def nan_strings(spark: SparkSession, folder: str) -> DataFrame:
    """Columns some of whose cells say 'nan' in some spelling."""
    return U.literal_nans(spark.sql(_CELLS, part=table(spark, folder, "part")))


@recorded("SELECT 'orders' AS check, count(*) AS rows, CASE WHEN count(*) = 0 THEN 'FAIL' WHEN count(*) BETWEEN 10 AND 1000000000 THEN 'PASS' ELSE 'INFO' END AS state FROM orders")
def row_band(spark: SparkSession, folder: str) -> DataFrame:
    return U.band_check(table(spark, folder, "orders"), "orders", 10, 1_000_000_000)


@recorded("SELECT count(DISTINCT o_custkey) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS only_ours, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS only_source FROM orders")
def source_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return U.agreement(table(spark, folder, "orders").select(F.col("o_custkey").alias("k")), table(spark, folder, "customer").select(F.col("c_custkey").alias("k")), "k")


@recorded(oracle("""WITH k AS (SELECT DISTINCT perf_id FROM performances), l AS (SELECT DISTINCT perf_id FROM performance_methods), u AS (SELECT DISTINCT perf_id FROM performance_method_unresolved)
SELECT count(*) AS keys, count(l.perf_id) AS linked, count(u.perf_id) AS unresolved, count(CASE WHEN l.perf_id = u.perf_id THEN 1 END) AS both, count(CASE WHEN l.perf_id IS NULL AND u.perf_id IS NULL THEN 1 END) AS neither
FROM k LEFT JOIN l ON l.perf_id = k.perf_id LEFT JOIN u ON u.perf_id = k.perf_id""", "performances", "performance_methods", "performance_method_unresolved"))
def link_coverage(spark: SparkSession, folder: str) -> DataFrame:
    c = Corpus(spark, folder)
    return U.coverage(c.performances, c.performance_methods, c.performance_method_unresolved, "perf_id")


@recorded("""WITH t AS (SELECT o_custkey, c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT o_custkey, c_mktsegment, n FROM t WHERE (SELECT count(*) FROM t x WHERE x.c_mktsegment = t.c_mktsegment AND abs(x.n - t.n) <= 2) = 1""")
def identifiable_members(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return U.identifiable(joined.groupBy("o_custkey", "c_mktsegment").agg(F.count("*").alias("n")), "c_mktsegment", "n")


@recorded("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the first half as the stored table, those of the second as the increment."""
    events, half = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts"), F.lit("2024-01-16").cast("timestamp")
    return U.upsert(events.where(F.col("ts") < half), events.where(F.col("ts") >= half), ["user_id"], [F.col("ts"), F.col("event_id")])


@recorded("SELECT user_id, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-16' OR user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16')")
def child_replace(spark: SparkSession, folder: str) -> DataFrame:
    events, half = table(spark, folder, "events").select("user_id", "event_id", "ts"), F.lit("2024-01-16").cast("timestamp")
    new = events.where(F.col("ts") >= half)
    return U.replace_children(events.where(F.col("ts") < half), new, "user_id", new).select("user_id", "event_id")


_PLACED = """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_returnflag END AS building, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('Town ', l_suppkey % 7) END AS town,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat('County ', l_suppkey % 2) END AS county, l_suppkey FROM {lineitem}"""
_VERDICTS = "SELECT DISTINCT building, town, county, concat_ws('/', coalesce(building, '-'), coalesce(town, '-'), coalesce(county, '-')) AS verdict FROM {placed} WHERE coalesce(town, 'Town 1') <> 'Town 2'"


@recorded(f"WITH placed AS ({_PLACED.format(lineitem='lineitem')}), verdicts AS ({_VERDICTS.format(placed='placed')}) SELECT p.l_orderkey, p.l_linenumber, p.building, p.town, p.county, v.verdict FROM placed p LEFT JOIN verdicts v ON p.building IS NOT DISTINCT FROM v.building AND p.town IS NOT DISTINCT FROM v.town AND p.county IS NOT DISTINCT FROM v.county")
def staged_update(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts by three columns, any of which may be null on both sides."""
    placed = spark.sql(_PLACED, lineitem=table(spark, folder, "lineitem"))
    verdicts = spark.sql(_VERDICTS, placed=placed)
    target = placed.select("l_orderkey", "l_linenumber", "building", "town", "county", F.lit(None).cast("string").alias("verdict"))
    return U.staged_update(target, verdicts, ["building", "town", "county"], "verdict")


@recorded("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events UNION ALL SELECT event_id, CAST(ts AS DATE) FROM events WHERE event_id % 97 = 5 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'),
t AS (SELECT DATE '2024-01-01' + CAST(7 * floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INT) AS begins, count(DISTINCT event_id) AS expected FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-29' GROUP BY 1),
w AS (SELECT CAST(b AS DATE) AS begins, least(CAST(b + INTERVAL 6 DAY AS DATE), DATE '2024-01-30') AS ends FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 7 DAY)) AS b)),
f AS (SELECT begins, ends, count(DISTINCT event_id) AS found, count(event_id) AS rows FROM w LEFT JOIN e ON d BETWEEN begins AND ends GROUP BY ALL),
g AS (SELECT f.begins, ends, CASE WHEN f.begins = DATE '2024-01-08' THEN expected + 1 ELSE coalesce(expected, 0) END AS expected, found, rows FROM f LEFT JOIN t ON t.begins = f.begins)
SELECT *, found = expected AND rows = found AS complete FROM g""")
def window_gate(spark: SparkSession, folder: str) -> DataFrame:
    """T4, T5: weekly windows against stated counts; one states an event more, one has rows twice, of one nothing is stated."""
    events = table(spark, folder, "events").select("event_id", "ts")
    spans = U.windows("2024-01-01", "2024-01-30", 7, spark)
    week = F.expr("date_add(DATE'2024-01-01', CAST(floor(datediff(ts, DATE'2024-01-01') / 7) * 7 AS INT))")
    truth = events.where("ts < DATE'2024-01-29'").groupBy(week.alias("begins")).agg(F.count_distinct("event_id").alias("n"))
    truth = truth.select("begins", F.when(F.col("begins") == F.lit("2024-01-08").cast("date"), F.col("n") + 1).otherwise(F.col("n")).alias("expected"))
    twice = events.where("event_id % 97 = 5 AND CAST(ts AS DATE) BETWEEN DATE'2024-01-15' AND DATE'2024-01-21'")
    return U.window_gate(events.union(twice), "ts", "event_id", truth, spans)


@recorded("SELECT CAST(max(ts) AS DATE) AS resume FROM events")
def high_water_mark(spark: SparkSession, folder: str) -> DataFrame:
    return U.resume_day(table(spark, folder, "events"), "ts")


@recorded(oracle("SELECT TowerID, Place, Dedicn, County, Country, Lat, Long, installations FROM towers_unique", "towers_unique"))
def view_towers_unique(spark: SparkSession, folder: str) -> DataFrame:
    return Corpus(spark, folder).towers_unique


@recorded(oracle("SELECT TowerID, RingID, DoveID, Place, County, Region, Country, RingType, Bells AS bell_count, Wt AS tenor_weight, Lat, Long, Practice, WebPage FROM towers", "towers"))
def view_ringing_towers(spark: SparkSession, folder: str) -> DataFrame:
    return V.ringing_towers(Corpus(spark, folder).dove)


@recorded(oracle("SELECT TowerID, min(RingID) AS primary_ring_id, count(*) AS rings, max(Place) AS Place, max(Dedicn) AS Dedicn, max(County) AS County FROM towers GROUP BY TowerID", "towers"))
def view_dove_towers(spark: SparkSession, folder: str) -> DataFrame:
    return V.dove_towers(Corpus(spark, folder).dove)


@recorded(oracle("SELECT perf_id, TowerID, u.Place AS tower_place, County FROM performances JOIN towers_unique u ON TowerID = dove_tower_id", "performances", "towers_unique"))
def view_tower_performances(spark: SparkSession, folder: str) -> DataFrame:
    return Corpus(spark, folder).tower_performances.select("perf_id", "TowerID", "tower_place", "County")


@recorded(oracle("""SELECT m.method_id, e.perf_date, e.dove_tower_id, Place FROM methods m LEFT JOIN method_performances e ON e.method_id = m.method_id AND event_type = 'firstTowerbellPeal'
LEFT JOIN towers_unique ON TowerID = e.dove_tower_id""", "methods", "method_performances", "towers_unique"))
def view_first_tower_peals(spark: SparkSession, folder: str) -> DataFrame:
    c = Corpus(spark, folder)
    return V.first_tower_peals(c.methods, c.method_performances, c.towers_unique).select("method_id", "perf_date", "dove_tower_id", "Place")


@recorded(oracle("SELECT perf_id, method_id, title AS method_title, stage, perf_date FROM performance_methods JOIN performances USING (perf_id) JOIN methods USING (method_id) WHERE confidence <> 'low'", "performance_methods", "performances", "methods"))
def view_performance_methods(spark: SparkSession, folder: str) -> DataFrame:
    c = Corpus(spark, folder)
    return V.performance_methods_view(c.performance_methods, c.performances, c.methods).select("perf_id", "method_id", "method_title", "stage", "perf_date")


@recorded("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begins, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ends, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    """An extension: the streaming aggregation on the finished table."""
    from loomspark.streaming.increments import tumbling

    return tumbling(table(spark, folder, "events"))


@recorded("""WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS begins FROM events) SELECT begins, begins + INTERVAL 2 HOUR AS ends, count(*) AS n FROM w GROUP BY ALL""")
def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    from loomspark.streaming.increments import sliding

    return sliding(table(spark, folder, "events"))


@recorded("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    from loomspark.streaming.increments import sessions

    return sessions(table(spark, folder, "events"))
