"""Analytic operators on the star and event tables, each with an oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.dialect import band
from loomspark.operators import analytics as A
from loomspark.operators import calendar as C
from loomspark.plans.bridge import Corpus, oracle
from loomspark.plans.registry import recorded
from loomspark.sources.tables import table

def row_count() -> Column:
    return F.count("*")


_DAYS = """
days AS (SELECT CAST(perf_date AS DATE) AS d, count(*) AS seen FROM performances GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM days), (SELECT max(d) FROM days), INTERVAL 1 DAY)) AS DATE) AS d),
daily AS (SELECT d, coalesce(seen, 0) AS n FROM spine LEFT JOIN days USING (d)),
base AS (SELECT a.d, a.n, median(b.n) AS base FROM daily a JOIN daily b ON b.d <> a.d AND abs(date_diff('day', a.d, b.d)) % 7 = 0 AND abs(date_diff('day', a.d, b.d)) <= 42 GROUP BY a.d, a.n HAVING count(*) >= 6 AND median(b.n) > 0),
rated AS (SELECT d, n, base, n / base AS ratio FROM base)"""
RATIO, LEAST = C.RATIO, C.LEAST


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return C.daily_counts(Corpus(spark, folder).performances.select("perf_date"), "perf_date")


@recorded(oracle(f"WITH {_DAYS} SELECT d, n FROM daily", "performances"))
def calendar_spine(spark: SparkSession, folder: str) -> DataFrame:
    return _daily(spark, folder)


@recorded(oracle(f"WITH {_DAYS} SELECT d, n, base, ratio FROM rated", "performances"))
def seasonal_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return C.with_baseline(_daily(spark, folder))


@recorded(oracle(f"WITH {_DAYS} SELECT d, n, base, ratio FROM rated WHERE ratio >= {RATIO} AND n >= {LEAST}", "performances"))
def calendar_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    """Days with 100 performances or more and 3.5 times their baseline."""
    return C.anomalies(_daily(spark, folder), RATIO, LEAST)


@recorded(oracle(f"WITH {_DAYS} SELECT d, n, base, ratio FROM rated WHERE ratio >= {0.75 * RATIO} AND NOT (ratio >= {RATIO} AND n >= {LEAST}) ORDER BY ratio DESC, d DESC LIMIT 8", "performances"))
def near_misses(spark: SparkSession, folder: str) -> DataFrame:
    return C.near_misses(_daily(spark, folder), RATIO, LEAST)


@recorded(oracle(f"""WITH {_DAYS}, event AS (SELECT d FROM rated WHERE ratio >= {RATIO} AND n >= {LEAST}),
label AS (SELECT CAST(perf_date AS DATE) AS d, association AS label, count(*) AS n FROM performances WHERE CAST(perf_date AS DATE) IN (SELECT d FROM event) GROUP BY ALL)
SELECT d, label, n, row_number() OVER (PARTITION BY d ORDER BY n DESC, label) AS place FROM label QUALIFY place <= 3""", "performances"))
def event_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The three most repeated labels of each event day."""
    events = C.anomalies(_daily(spark, folder), RATIO, LEAST).select("d")
    rows = Corpus(spark, folder).performances.select(F.col("perf_date").cast("date").alias("d"), F.col("association").alias("label"))
    counts = rows.join(events, "d", "left_semi").groupBy("d", "label").agg(row_count().alias("n"))
    return A.top_per_key(counts, ["d"], [F.desc("n"), F.col("label")], 3)


@recorded(oracle(f"""WITH {_DAYS} SELECT CAST(dayofweek(d) AS INT) AS dow, CAST(year(d) AS INT) AS year, CAST(sum(n) AS BIGINT) AS n, count(*) AS days FROM daily
WHERE d NOT IN (SELECT d FROM rated WHERE ratio >= {RATIO} AND n >= {LEAST}) GROUP BY ALL""", "performances"))
def weekday_profile_net(spark: SparkSession, folder: str) -> DataFrame:
    """Weekday profile by year without event days."""
    days = _daily(spark, folder)
    quiet = days.join(C.anomalies(days, RATIO, LEAST).select("d"), "d", "left_anti")
    return quiet.groupBy((F.dayofweek("d") - 1).alias("dow"), F.year("d").alias("year")).agg(F.sum("n").alias("n"), row_count().alias("days"))


@recorded(oracle(f"""WITH {_DAYS} SELECT CAST(month(d) AS INT) AS month, CAST(sum(n) AS BIGINT) AS raw,
  CAST(sum(CASE WHEN d IN (SELECT d FROM rated WHERE ratio >= {RATIO} AND n >= {LEAST}) THEN 0 ELSE n END) AS BIGINT) AS net FROM daily GROUP BY 1""", "performances"))
def month_raw_vs_net(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by month, with and without event days."""
    days = _daily(spark, folder)
    marked = days.join(C.anomalies(days, RATIO, LEAST).select("d", F.lit(1).alias("event")), "d", "left")
    return marked.groupBy(F.month("d").alias("month")).agg(F.sum("n").alias("raw"), F.sum(F.when(F.col("event").isNull(), F.col("n")).otherwise(0)).alias("net"))


@recorded("""WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders),
f AS (SELECT year, CAST(make_date(year, 11, 1) + CAST((7 - dayofweek(make_date(year, 11, 1))) % 7 + 7 AS INT) AS DATE) AS d FROM y)
SELECT f.year, f.d, count(o_orderkey) AS n FROM f LEFT JOIN orders ON CAST(o_orderdate AS DATE) = f.d GROUP BY ALL""")
def moving_feast(spark: SparkSession, folder: str) -> DataFrame:
    """Orders on the second Sunday of November of each year, 0 where there are none."""
    orders = table(spark, folder, "orders")
    feasts = C.second_sunday_of_november(orders.select(F.year("o_orderdate").alias("year")).distinct())
    counts = orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(row_count().alias("seen"))
    return feasts.join(counts, "d", "left").select("year", "d", F.coalesce("seen", F.lit(0)).alias("n"))


@recorded("SELECT o_custkey, p AS percent, list_sort(list(o_totalprice))[CAST(round_even(p / 100.0 * (count(*) - 1), 0) AS INT) + 1] AS value FROM orders, (VALUES (10), (25), (50), (90)) t(p) GROUP BY o_custkey, p")
def nearest_rank_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return A.nearest_rank(table(spark, folder, "orders"), ["o_custkey"], "o_totalprice", [10, 25, 50, 90])


@recorded("""
WITH r AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders)
SELECT o_custkey, min(CASE WHEN o_orderstatus = 'F' THEN k END) AS wait FROM r GROUP BY o_custkey""")
def apprenticeship_wait(spark: SparkSession, folder: str) -> DataFrame:
    """Appearances before the first event; null if it never comes."""
    orders = table(spark, folder, "orders")
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return orders.select("o_custkey", "o_orderstatus", at.alias("at")).groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", F.col("at"))).cast("long").alias("wait"))


@recorded("""
WITH c AS (SELECT o_custkey, min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(first AS INT) AS first_year, count(*) AS members, count(*) FILTER (WHERE last <= 2000) AS gone, count(*) FILTER (WHERE n >= 12) AS active, count(*) FILTER (WHERE n >= 12 AND last <= 2000) AS active_gone FROM c GROUP BY 1""")
def cohort_attrition(spark: SparkSession, folder: str) -> DataFrame:
    """Members by first year, and how many were last seen by 2000; all and the active ones."""
    year = F.year("o_orderdate")
    each = table(spark, folder, "orders").groupBy("o_custkey").agg(F.min(year).alias("first_year"), F.max(year).alias("last"), row_count().alias("n"))
    gone, active = F.col("last") <= 2000, F.col("n") >= 12
    return each.groupBy("first_year").agg(row_count().alias("members"), F.count_if(gone).alias("gone"), F.count_if(active).alias("active"), F.count_if(active & gone).alias("active_gone"))


@recorded("""
WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
b AS (SELECT o_custkey, avg(CASE WHEN rn <= greatest(1, n // 10) THEN o_totalprice END) AS early, avg(CASE WHEN rn > n - greatest(1, n // 10) THEN o_totalprice END) AS late FROM r WHERE n >= 10 GROUP BY 1)
SELECT count(*) AS cohort, count(*) FILTER (WHERE late / early - 1 > 0.05) AS up, count(*) FILTER (WHERE late / early - 1 < -0.05) AS down, count(*) FILTER (WHERE abs(late / early - 1) <= 0.05) AS stayed FROM b""")
def career_drift(spark: SparkSession, folder: str) -> DataFrame:
    """First against last tenth of each customer's orders, at least one order each."""
    own = Window.partitionBy("o_custkey")
    ranked = table(spark, folder, "orders").select("o_custkey", "o_totalprice", F.row_number().over(own.orderBy("o_orderdate", "o_orderkey")).alias("rn"), row_count().over(own).alias("n")).where("n >= 10")
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    each = ranked.groupBy("o_custkey").agg(F.avg(F.when(F.col("rn") <= k, F.col("o_totalprice"))).alias("early"), F.avg(F.when(F.col("rn") > F.col("n") - k, F.col("o_totalprice"))).alias("late"))
    drift = F.col("late") / F.col("early") - 1
    return each.agg(row_count().alias("cohort"), F.count_if(drift > 0.05).alias("up"), F.count_if(drift < -0.05).alias("down"), F.count_if(F.abs(drift) <= 0.05).alias("stayed"))


@recorded("SELECT CAST(least(floor(10 * (high / total)), 9) AS BIGINT) AS band, count(*) AS customers FROM (SELECT o_custkey, sum(CASE WHEN o_totalprice >= 250000 THEN 1.0::DOUBLE ELSE 0.0 END) AS high, count(*) AS total FROM orders GROUP BY 1) GROUP BY 1")
def share_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Customers by the share of large orders."""
    each = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") >= 250000).alias("high"), row_count().alias("total"))
    return each.groupBy(band(F.col("high") / F.col("total")).cast("long").alias("band")).agg(row_count().alias("customers"))


@recorded("SELECT t AS threshold, count(*) FILTER (WHERE n >= t) AS rows, CAST(coalesce(sum(n) FILTER (WHERE n >= t), 0) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey), (VALUES (1), (5), (10), (12), (15), (20)) v(t) GROUP BY t")
def threshold_ladder(spark: SparkSession, folder: str) -> DataFrame:
    return A.ladder(table(spark, folder, "orders").groupBy("o_custkey").agg(row_count().alias("n")), "n", [1, 5, 10, 12, 15, 20])


@recorded("SELECT CAST(CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 25 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def uneven_bins(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(A.edge_bins(F.col("l_quantity"), [5, 10, 25, 40]).alias("bin")).agg(row_count().alias("n"))


@recorded("SELECT k, (SELECT count(*) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) c WHERE c.n <= k) AS at_most FROM (SELECT unnest(generate_series(0, 30)) AS k)")
def conducting_curve(spark: SparkSession, folder: str) -> DataFrame:
    return A.cumulative_curve(table(spark, folder, "orders").groupBy("o_custkey").agg(row_count().alias("n")), "n", 30)


@recorded("SELECT l_partkey, l_returnflag, n FROM (SELECT l_partkey, l_returnflag, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_returnflag) AS p FROM lineitem GROUP BY l_partkey, l_returnflag) WHERE p = 1")
def mode_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return A.most_common(table(spark, folder, "lineitem"), ["l_partkey"], "l_returnflag")


@recorded("SELECT l_returnflag, median(l_quantity) AS median, round(avg(l_tax), 12) AS mean FROM lineitem GROUP BY 1")
def median_and_mean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median"), F.round(F.avg("l_tax"), 12).alias("mean"))


@recorded("WITH o AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS m FROM lineitem) SELECT a.m AS a, b.m AS b, count(*) AS n FROM o a JOIN o b ON a.k = b.k AND a.m < b.m GROUP BY 1, 2 HAVING count(*) >= 5")
def co_occurrence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return A.co_occurrence(table(spark, folder, "lineitem"), "l_orderkey", "l_suppkey", 5)


@recorded("""WITH o AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS m FROM lineitem), e AS (SELECT a.m AS m, b.m AS partner, count(*) AS n FROM o a JOIN o b ON a.k = b.k AND a.m <> b.m GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT m, partner, n, row_number() OVER (PARTITION BY m ORDER BY n DESC, partner) AS place FROM e QUALIFY place <= 5""")
def top_partners(spark: SparkSession, folder: str) -> DataFrame:
    """The five closest partners of each member, ties by id."""
    pairs = A.co_occurrence(table(spark, folder, "lineitem"), "l_orderkey", "l_suppkey", 5)
    both = pairs.select(F.col("a").alias("m"), F.col("b").alias("partner"), "n").union(pairs.select("b", "a", "n"))
    return A.top_per_key(both, ["m"], [F.desc("n"), F.col("partner")], 5)


@recorded("SELECT p_type, p_brand, p_partkey, linked FROM (SELECT p_type, p_brand, p_partkey, lag(p_partkey) OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice DESC, p_partkey) AS linked FROM part WHERE p_brand IS NOT NULL) WHERE linked IS NOT NULL")
def symmetry_chain(spark: SparkSession, folder: str) -> DataFrame:
    return A.chain_links(table(spark, folder, "part"), ["p_type", "p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], "p_partkey")


@recorded("""WITH t AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), k AS (SELECT p_brand FROM t ORDER BY n DESC, p_brand LIMIT 8)
SELECT CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE 'Other' END AS p_brand, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1""")
def top_k_other(spark: SparkSession, folder: str) -> DataFrame:
    return A.top_or_other(table(spark, folder, "part"), "p_brand", 8)


@recorded("SELECT o_orderkey, o_custkey FROM orders ORDER BY (o_orderkey * 2654435761) % 1000003, o_orderkey LIMIT 1500")
def knuth_sample(spark: SparkSession, folder: str) -> DataFrame:
    return A.knuth_sample(table(spark, folder, "orders"), "o_orderkey", 1500).select("o_orderkey", "o_custkey")


@recorded("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat('7:', o_orderkey)), o_orderkey LIMIT 2000")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded sample by a hash of the seed and the key."""
    return A.seeded_sample(table(spark, folder, "orders"), "o_orderkey", 7, 2000).select("o_orderkey", "o_custkey")


@recorded("SELECT DISTINCT 'customer' AS source, c_nationkey AS nationkey FROM customer UNION ALL SELECT DISTINCT 'supplier', s_nationkey FROM supplier")
def union_distinct_sources(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda t, c: table(spark, folder, t).select(F.lit(t).alias("source"), F.col(c).alias("nationkey")).distinct()
    return part("customer", "c_nationkey").unionByName(part("supplier", "s_nationkey"))


@recorded("SELECT p_name, p_size, p_partkey, first_date FROM (SELECT *, count(*) OVER (PARTITION BY p_name) AS members FROM part JOIN (SELECT l_partkey, CAST(min(l_shipdate) AS DATE) AS first_date FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) WHERE members > 1 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY first_date, p_partkey) = 1")
def family_earliest(spark: SparkSession, folder: str) -> DataFrame:
    """The first-shipped part of each name with several parts, ties by key."""
    first = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_shipdate").cast("date").alias("first_date"))
    each = table(spark, folder, "part").join(first, "p_partkey").groupBy("p_name").agg(F.min(F.struct("first_date", "p_partkey", "p_size")).alias("b"), row_count().alias("members"))
    return each.where("members > 1").select("p_name", "b.p_size", "b.p_partkey", "b.first_date")


@recorded("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, value IS NULL, event_type, event_id) = 1")
def first_event_deterministic(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's earliest event, ties by a stated order."""
    best = F.min(F.struct("ts", F.col("value").isNull().alias("no_value"), "event_type", "event_id")).alias("b")
    return table(spark, folder, "events").groupBy("user_id").agg(best).select("user_id", "b.event_id", "b.event_type")


@recorded("SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type", F.from_json("props", "k int")["k"].alias("k")).agg(row_count().alias("n"))


@recorded("""
WITH f AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad FROM events), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM f),
r AS (SELECT user_id, i, sum(CAST(bad AS INT)) AS run FROM g GROUP BY 1, 2) SELECT user_id, CAST(max(run) AS BIGINT) AS longest FROM r GROUP BY 1""")
def longest_error_run(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps and islands."""
    return A.longest_runs(table(spark, folder, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")


@recorded("""
WITH b AS (SELECT o_custkey, o_orderstatus, list_distinct(list(o_orderpriority)) AS p FROM orders GROUP BY ALL), c AS (SELECT c_nationkey, c_mktsegment, list_distinct(list(o_orderpriority)) AS p, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT a.c_nationkey, a.c_mktsegment AS a, b.c_mktsegment AS b, CAST(len(list_intersect(a.p, b.p)) AS DOUBLE) / len(list_distinct(list_concat(a.p, b.p))) AS jaccard FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment < b.c_mktsegment""")
def jaccard_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs inside a block (segments of a nation: five rows each), by shared priorities."""
    sets = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "c_mktsegment").agg(F.collect_set("o_orderpriority").alias("p"))
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, (F.col("a.c_nationkey") == F.col("b.c_nationkey")) & (F.col("a.c_mktsegment") < F.col("b.c_mktsegment")))
    return pairs.select("a.c_nationkey", F.col("a.c_mktsegment").alias("a"), F.col("b.c_mktsegment").alias("b"), A.jaccard(F.col("a.p"), F.col("b.p")).alias("jaccard"))


@recorded("SELECT a.p_name, a.p_partkey AS parent, b.p_partkey AS child FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_size < b.p_size")
def same_name_larger(spark: SparkSession, folder: str) -> DataFrame:
    """An equal key with a range beside it."""
    a, b = table(spark, folder, "part").alias("a"), table(spark, folder, "part").alias("b")
    on = (F.col("a.p_name") == F.col("b.p_name")) & (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_size") < F.col("b.p_size"))
    return a.join(b, on).select("a.p_name", F.col("a.p_partkey").alias("parent"), F.col("b.p_partkey").alias("child"))


@recorded("""WITH p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), q AS (SELECT o_orderkey AS k FROM orders)
SELECT count(*) FILTER (WHERE p.k IS NOT NULL AND q.k IS NOT NULL) AS both, count(*) FILTER (WHERE q.k IS NULL) AS only_left, count(*) FILTER (WHERE p.k IS NULL) AS only_right FROM p FULL JOIN q ON p.k = q.k""")
def key_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Two link sets compared by a full outer join."""
    p = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("l", F.lit(1))
    q = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k")).withColumn("r", F.lit(1))
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()  # noqa: E741
    return p.join(q, "k", "full").agg(F.count_if(l & r).alias("both"), F.count_if(~r).alias("only_left"), F.count_if(~l).alias("only_right"))


@recorded("""WITH RECURSIVE t AS (SELECT r_regionkey AS id, r_name AS path, 0 AS depth FROM region), u AS (SELECT 'r' || id AS id, path, depth FROM t UNION ALL SELECT 'n' || n_nationkey, path || '/' || n_name, 1 FROM nation JOIN t ON t.id = n_regionkey)
SELECT id, path, depth FROM u""")
def containment_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Places with the path of those that contain them."""
    regions, nations = table(spark, folder, "region"), table(spark, folder, "nation")
    tops = regions.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("path"), F.lit(0).alias("depth"))
    inner = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n"), F.col("n_nationkey")), F.concat_ws("/", "r_name", "n_name"), F.lit(1))
    return tops.union(inner)


@recorded("""
WITH k AS (SELECT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT 'customer' AS kind, c AS id, 1 + CAST(0.5 AS DOUBLE) * count(*) AS weight, count(DISTINCT s) AS links FROM k GROUP BY c UNION ALL SELECT 'supplier', s, 1 + CAST(0.2 AS DOUBLE) * count(*), count(DISTINCT c) FROM k GROUP BY s""")
def nexus_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of a two-kind graph with the weight of their touches."""
    links = table(spark, folder, "orders").join(table(spark, folder, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s"))
    kind = lambda name, own, other, w: links.groupBy(F.col(own).alias("id")).agg(row_count().alias("n"), F.count_distinct(other).alias("links")).select(F.lit(name).alias("kind"), "id", (1 + w * F.col("n")).alias("weight"), "links")
    return kind("customer", "c", "s", 0.5).union(kind("supplier", "s", "c", 0.2))


@recorded("""WITH f AS (SELECT p_brand, p_type, p_size, p_partkey FROM part) SELECT p_brand AS family, count(*) AS members, list_aggregate(list_sort(list_distinct(list(p_size))), 'string_agg', ',') AS stages, min(p_partkey) AS first_member, arg_min(p_type, concat(lpad(CAST(1000000 - c AS STRING), 9, '0'), p_type)) AS modal_class
FROM f JOIN (SELECT p_brand AS b, p_type AS t, count(*) AS c FROM part GROUP BY 1, 2) ON b = p_brand AND t = p_type GROUP BY p_brand""")
def lineage_families(spark: SparkSession, folder: str) -> DataFrame:
    """Each family's members, stages in order and most common class."""
    parts = table(spark, folder, "part")
    modal = A.most_common(parts, ["p_brand"], "p_type").select("p_brand", F.col("p_type").alias("modal_class"))
    each = parts.groupBy("p_brand").agg(row_count().alias("members"), F.array_join(F.transform(F.array_sort(F.collect_set("p_size")), lambda x: x.cast("string")), ",").alias("stages"), F.min("p_partkey").alias("first_member"))
    return each.join(modal, "p_brand").withColumnRenamed("p_brand", "family")


@recorded("SELECT count(*) AS orders, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(DISTINCT o_custkey) FROM orders) AS customers, (SELECT count(*) FROM part) AS parts FROM orders")
def headline_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Four counts."""
    orders = table(spark, folder, "orders").agg(row_count().alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    return orders.join(table(spark, folder, "lineitem").agg(row_count().alias("lines"))).join(table(spark, folder, "part").agg(row_count().alias("parts")))


@recorded("""WITH d AS (SELECT l_partkey, min(CAST(l_shipdate AS DATE)) AS debut FROM lineitem GROUP BY 1)
SELECT CAST(year(debut) AS INT) AS year, CAST(p_size % 9 + 4 AS INT) AS stage, p_type AS class, count(*) AS debuts, count(DISTINCT debut) AS days FROM d JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def debuts_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """Debuts by year, stage and class, and the days that they share."""
    debut = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_shipdate").cast("date").alias("debut"))
    return debut.join(table(spark, folder, "part"), "p_partkey").groupBy(F.year("debut").alias("year"), (F.col("p_size") % 9 + 4).alias("stage"), F.col("p_type").alias("class")).agg(row_count().alias("debuts"), F.count_distinct("debut").alias("days"))


@recorded("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND p_type = 'ECONOMY' AND p_name ILIKE '%RING%' ORDER BY p_partkey LIMIT 240")
def library_search(spark: SparkSession, folder: str) -> DataFrame:
    """Stage, class and title filters, the first 240."""
    return table(spark, folder, "part").where(F.col("p_size").between(5, 20) & (F.col("p_type") == "ECONOMY") & F.col("p_name").ilike("%RING%")).orderBy("p_partkey").limit(240).select("p_partkey", "p_name")


@recorded("SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal BETWEEN 1000 AND 6000 AND n_regionkey IN (1, 2)")
def window_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A range window and a group filter."""
    nations = table(spark, folder, "nation").where(F.col("n_regionkey").isin(1, 2))
    return table(spark, folder, "supplier").where(F.col("s_acctbal").between(1000, 6000)).join(nations, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name")


@recorded("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), row_count().alias("count_order"))
