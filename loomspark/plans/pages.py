"""The datasets behind pages: dominant groups, populations, practice tiers, occasions by month, verified methods, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.dialect import band, filled, tenths
from loomspark.operators import analytics as A
from loomspark.operators import classify as K
from loomspark.operators import kernel
from loomspark.plans.bridge import Corpus
from loomspark.plans.findings import WEEKNIGHTS, over, q40_practice_weeknight
from loomspark.plans.kernel_queries import _VALUES, methods
from loomspark.plans.registry import recorded
from loomspark.sources.tables import table


def _cast(c: Corpus) -> DataFrame:
    """Attributed bells with the year of their casting, if it can be one."""
    owned = c.founders.where("founder_group IS NOT NULL").select(F.col("Name").alias("Founder"), "founder_group")
    year = F.regexp_extract("Cast_Date", r"(1\d{3}|20\d{2})", 1).try_cast("int")
    return c.bells.where("Latitude IS NOT NULL").join(owned, "Founder").select("Tower_ID", "founder_group", F.when(year.between(1200, 2026), year).alias("year"))


_CAST = "b AS (SELECT Tower_ID, founder_group, TRY_CAST(regexp_extract(Cast_Date, '(1\\d{3}|20\\d{2})', 1) AS INT) AS year FROM bells JOIN founders ON Name = Founder WHERE founder_group IS NOT NULL AND Latitude IS NOT NULL)"


#: Groups that stand for themselves; the bells of all others are 'Other'.
TOP_GROUPS = 8
_TOP = f"top AS (SELECT founder_group AS g FROM b GROUP BY 1 ORDER BY count(*) DESC, g LIMIT {TOP_GROUPS}), m AS (SELECT Tower_ID, year, CASE WHEN founder_group IN (SELECT g FROM top) THEN founder_group ELSE 'Other' END AS founder_group FROM b)"


def _grouped(c: Corpus) -> DataFrame:
    """`_cast` with every group but the TOP_GROUPS ones of most bells, ties by name, as 'Other'."""
    cast = _cast(c)
    top = cast.groupBy("founder_group").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "founder_group").limit(TOP_GROUPS).select("founder_group", F.lit(True).alias("top"))
    return cast.join(F.broadcast(top), "founder_group", "left").withColumn("founder_group", F.when(F.col("top"), F.col("founder_group")).otherwise("Other")).drop("top")  # TOP_GROUPS rows


@over(f"WITH {_CAST}, {_TOP}, g AS (SELECT Tower_ID, founder_group, count(*) AS n FROM m GROUP BY ALL) SELECT Tower_ID, arg_min(founder_group, concat(lpad(CAST(100000 - n AS STRING), 9, '0'), founder_group)) AS dominant, CAST(sum(n) AS BIGINT) AS bells, (SELECT min(year) FROM b x WHERE x.Tower_ID = g.Tower_ID) AS earliest FROM g GROUP BY Tower_ID", "bells", "founders")
def atlas_towers(c: Corpus) -> DataFrame:
    """Each tower's dominant group, bells and earliest year."""
    cast = _grouped(c)
    dominant = A.most_common(cast, ["Tower_ID"], "founder_group").select("Tower_ID", F.col("founder_group").alias("dominant"))
    return cast.groupBy("Tower_ID").agg(F.count("*").alias("bells"), F.min("year").alias("earliest")).join(dominant, "Tower_ID")


@over(f"WITH {_CAST}, {_TOP} SELECT CAST(year // 25 * 25 AS INT) AS quarter_century, founder_group, count(*) AS n FROM m WHERE year >= 1400 GROUP BY ALL", "bells", "founders")
def atlas_timeline(c: Corpus) -> DataFrame:
    """Bells of each group by quarter-century."""
    return _grouped(c).where("year >= 1400").groupBy((F.floor(F.col("year") / 25) * 25).cast("int").alias("quarter_century"), "founder_group").agg(F.count("*").alias("n"))


@over("""SELECT CAST(10 * least(floor(10.0 * peals / n), 9) AS BIGINT) AS band, count(*) AS towers FROM (SELECT dove_tower_id, CAST(sum(CASE WHEN changes >= 5000 THEN 1 ELSE 0 END) AS DOUBLE) AS peals, count(*) AS n
FROM performances WHERE dove_tower_id IS NOT NULL AND changes IS NOT NULL AND ring_type = 'tower' GROUP BY 1 HAVING count(*) >= 50) GROUP BY 1""", "performances")
def population_towers(c: Corpus) -> DataFrame:
    """Towers by the share of peals in their performances."""
    rung = c.performances.where("dove_tower_id IS NOT NULL AND changes IS NOT NULL AND ring_type = 'tower'")
    each = rung.groupBy("dove_tower_id").agg(F.count_if(F.col("changes") >= 5000).alias("peals"), F.count("*").alias("n")).where("n >= 50")
    return each.groupBy((10 * band(F.col("peals") / F.col("n"))).cast("long").alias("band")).agg(F.count("*").alias("towers"))


@over("SELECT CASE WHEN changes < 1000 THEN 'under 1000' WHEN changes < 1400 THEN 'quarters' WHEN changes < 5000 THEN 'middling' ELSE 'peals' END AS length, count(*) AS n FROM performances WHERE changes >= 0 GROUP BY 1", "performances")
def population_lengths(c: Corpus) -> DataFrame:
    """Performances by length."""
    x = F.col("changes")
    return c.performances.where(x >= 0).groupBy(F.when(x < 1000, "under 1000").when(x < 1400, "quarters").when(x < 5000, "middling").otherwise("peals").alias("length")).agg(F.count("*").alias("n"))


@over("""WITH r AS (SELECT trim(name) AS ringer, changes, CAST(substr(perf_date, 1, 4) AS INT) AS y FROM performance_ringers JOIN performances USING (perf_id) WHERE trim(name) <> ''),
e AS (SELECT ringer, max(y) - min(y) AS years, count(changes) AS n, sum(CASE WHEN changes >= 5000 THEN 1 ELSE 0 END) AS peals FROM r GROUP BY 1)
SELECT years, count(*) AS ringers, count(*) FILTER (WHERE peals > 0) AS ever FROM e WHERE n >= 50 GROUP BY 1 HAVING count(*) >= 5""", "performance_ringers", "performances")
def population_experience(c: Corpus) -> DataFrame:
    """Ringers by the years that they span and how many ever rang a peal."""
    rung = c.performance_ringers.where(filled(F.col("name"))).join(c.performances, "perf_id").select(F.trim("name").alias("ringer"), "changes", F.substring("perf_date", 1, 4).try_cast("int").alias("y"))
    each = rung.groupBy("ringer").agg((F.max("y") - F.min("y")).alias("years"), F.count("changes").alias("n"), F.count_if(F.col("changes") >= 5000).alias("peals")).where("n >= 50")
    return each.groupBy("years").agg(F.count("*").alias("ringers"), F.count_if(F.col("peals") > 0).alias("ever")).where("ringers >= 5")


@over(f"""WITH q AS ({WEEKNIGHTS}) SELECT CASE WHEN total_weekday < 50 THEN '20-49' WHEN total_weekday < 100 THEN '50-99' WHEN total_weekday < 200 THEN '100-199' ELSE '200+' END AS tier,
count(*) AS towers, round(100 * avg(is_busiest), 1) AS rate, round(avg(stated_night_pct), 1) AS share FROM q GROUP BY 1""", "performances", "dove")
def practice_tiers(c: Corpus) -> DataFrame:
    """Towers, rate and mean share by activity, over the statement Q40."""
    return by_tier(q40_practice_weeknight(c))


def by_tier(rows: DataFrame) -> DataFrame:
    """Towers, rate and mean share of the rows of Q40 by activity."""
    t = F.col("total_weekday")
    tier = F.when(t < 50, "20-49").when(t < 100, "50-99").when(t < 200, "100-199").otherwise("200+")
    # shares have one decimal, so their sum is exact in any order
    share = F.sum(F.col("stated_night_pct").cast("decimal(4,1)")).cast("double") / F.count("stated_night_pct")
    return rows.groupBy(tier.alias("tier")).agg(F.count("*").alias("towers"), tenths(100 * F.avg("is_busiest")).alias("rate"), tenths(share).alias("share"))


@over("""WITH f AS (SELECT CASE WHEN footnote ILIKE '%fallen%' THEN 'none' WHEN footnote ILIKE '%first%' THEN 'first' WHEN footnote ILIKE '%wedding%' THEN 'wedding' END AS label, CAST(substr(perf_date, 6, 2) AS INT) AS month, changes FROM performance_footnotes JOIN performances USING (perf_id) WHERE footnote <> '')
SELECT label, coalesce(month, 1) AS month, count(*) AS n, count(CASE WHEN changes BETWEEN 100 AND 15000 THEN 1 END) AS timed FROM f WHERE label IN ('first', 'wedding') GROUP BY ALL""", "performance_footnotes", "performances")
def occasions_by_month(c: Corpus) -> DataFrame:
    """Footnotes of each occasion by month, January where the date is none, and those of a likely length."""
    notes = c.performance_footnotes.where("footnote <> ''").join(c.performances.select("perf_id", "perf_date", "changes"), "perf_id")
    rows = notes.select(F.explode(K.labels(F.col("footnote"), K.OCCASIONS)).alias("label"), F.coalesce(F.month(F.try_to_date("perf_date", "yyyy-MM-dd")), F.lit(1)).alias("month"), "changes")
    return rows.groupBy("label", "month").agg(F.count("*").alias("n"), F.count_if(F.col("changes").between(100, 15000)).alias("timed"))


@recorded(f"SELECT CAST(stage AS INT) AS stage, count(*) AS verified FROM (VALUES {_VALUES}) t(title, stage, notation, lead_head) WHERE stage IN (6, 8, 10, 12) GROUP BY 1")
def verified_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Methods whose computed lead head is the published one, at the stages that are drawn."""
    right = methods(spark).where(kernel.lead_head(F.col("notation"), F.col("stage")) == F.col("lead_head"))
    return right.where(F.col("stage").isin(6, 8, 10, 12)).groupBy("stage").agg(F.count("*").alias("verified"))


#: The most leads after which an order of up to 16 bells comes back.
LONGEST = 140


@recorded("SELECT * FROM (VALUES ('Plain Bob Minor', 5, 61), ('Plain Bob Major', 7, 113), ('Cambridge Surprise Minor', 5, 121)) t(title, leads, rows)")
def plain_courses(spark: SparkSession, folder: str) -> DataFrame:
    """Leads of the plain course until rounds come back, and its rows with both rounds."""
    return _courses(methods(spark).where(F.col("title").isin("Plain Bob Minor", "Plain Bob Major", "Cambridge Surprise Minor")))


@recorded(f"""WITH RECURSIVE m AS (SELECT title, lead_head, left('1234567890ETABCD', stage) AS first, len(regexp_extract_all(split_part(notation, ',', 1), '[-xX]|[^-xX.]+')) AS a, len(regexp_extract_all(split_part(notation, ',', 2), '[-xX]|[^-xX.]+')) AS b FROM (VALUES {_VALUES}) t(title, stage, notation, lead_head)),
c AS (SELECT title, first, lead_head, CASE WHEN b > 0 THEN 2 * a - 1 + b ELSE a END AS lead, lead_head AS here, 1 AS leads FROM m
UNION ALL SELECT title, first, lead_head, lead, array_to_string([substr(here, strpos(first, substr(lead_head, CAST(i AS INT), 1)), 1) for i in range(1, length(first) + 1)], ''), leads + 1 FROM c WHERE here <> first)
SELECT title, max(leads) AS leads, max(leads) * any_value(lead) + 1 AS rows FROM c GROUP BY title""")
def plain_courses_all(spark: SparkSession, folder: str) -> DataFrame:
    """N23 for all methods."""
    return _courses(methods(spark))


def _courses(found: DataFrame) -> DataFrame:
    heads = found.select("title", "stage", F.split("lead_head", "").alias("end"), F.size(kernel.expand(F.col("notation"), "mirror_drop_last")).alias("lead"))
    first = kernel.rounds(F.col("stage"))
    step = lambda a, k: F.when(a["done"], a).otherwise(_next(a, first))
    start = F.struct(first.alias("row"), F.lit(0).alias("leads"), F.lit(False).alias("done"))

    def _next(a, order):
        row = F.transform(F.col("end"), lambda b: F.element_at(a["row"], F.array_position(order, b).cast("int")))
        return F.struct(row.alias("row"), (a["leads"] + 1).alias("leads"), (row == order).alias("done"))

    leads = F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST)), start, step, lambda a: a["leads"])
    return heads.select("title", leads.alias("leads"), (leads * F.col("lead") + 1).alias("rows"))


@recorded("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%#00000001%' OR CAST(c_custkey AS STRING) LIKE '%99%' ORDER BY c_custkey LIMIT 50")
def people_search(spark: SparkSession, folder: str) -> DataFrame:
    """A name or an id that has the text, the first 50."""
    hit = F.col("c_name").ilike("%#00000001%") | F.col("c_custkey").cast("string").contains("99")
    return table(spark, folder, "customer").where(hit).orderBy("c_custkey").limit(50).select("c_custkey", "c_name")


@recorded("SELECT o_orderkey FROM orders WHERE CAST(CAST(o_orderdate AS DATE) AS STRING) LIKE '1998-0%' AND o_orderstatus = 'F' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_orderkey LIMIT 150")
def day_search(spark: SparkSession, folder: str) -> DataFrame:
    """Day prefix, state and text, the first 150."""
    day = F.col("o_orderdate").cast("date").cast("string")
    return table(spark, folder, "orders").where(day.startswith("1998-0") & (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").ilike("%urgent%")).orderBy("o_orderkey").limit(150).select("o_orderkey")


@recorded("SELECT CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN p_type ELSE 'Other' END AS class, count(*) AS n FROM part GROUP BY 1")
def class_isolation(spark: SparkSession, folder: str) -> DataFrame:
    """Named classes and all others."""
    return table(spark, folder, "part").groupBy(F.when(F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO"), F.col("p_type")).otherwise("Other").alias("class")).agg(F.count("*").alias("n"))


@over("""WITH d AS (SELECT method_id, min(perf_date) AS debut FROM method_performances WHERE perf_date <> '' GROUP BY 1)
SELECT CASE WHEN debut < '1900' THEN 'before 1900' WHEN debut < '1998' THEN 'to 1997' ELSE 'from 1998' END AS era, count(*) AS methods, count(*) FILTER (WHERE method_id IN (SELECT method_id FROM performance_methods WHERE confidence = 'high')) AS in_use FROM d GROUP BY 1""", "method_performances", "performance_methods")
def currency_by_era(c: Corpus) -> DataFrame:
    """Methods by the era of their debut, and those with a sure link."""
    debut = c.method_performances.where("perf_date <> ''").groupBy("method_id").agg(F.min("perf_date").alias("debut"))
    used = c.performance_methods.where("confidence = 'high'").select("method_id").distinct().withColumn("used", F.lit(1))
    era = F.when(F.col("debut") < "1900", "before 1900").when(F.col("debut") < "1998", "to 1997").otherwise("from 1998")
    return debut.join(used, "method_id", "left").groupBy(era.alias("era")).agg(F.count("*").alias("methods"), F.count("used").alias("in_use"))


#: Performances of the nexus page.
NEXUS = 1500
_NEXUS = f"""p AS (SELECT perf_id, concat('P_', perf_id) AS pid, place, method, perf_date FROM performances WHERE method <> '' ORDER BY (perf_id * 2654435761) % 1000003, perf_id LIMIT {NEXUS}),
r AS (SELECT p.pid, p.perf_date, x.name, x.bell FROM performance_ringers x JOIN p ON p.perf_id = x.perf_id)"""


def _nexus(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """The sampled performances, spread by Knuth's multiplier, and their ringers."""
    some = c.performances.where("method <> ''").orderBy((F.col("perf_id") * 2654435761) % 1000003, "perf_id").limit(NEXUS)
    perfs = some.select("perf_id", F.concat(F.lit("P_"), F.col("perf_id").cast("string")).alias("pid"), "place", "method", "perf_date")
    ringers = c.performance_ringers.join(F.broadcast(perfs.select("perf_id", "pid", "perf_date")), "perf_id").select("pid", "perf_date", "name", "bell")  # NEXUS rows
    return perfs, ringers


_NODE = "concat('{k}_', coalesce({c}, 'None'))"


@over(f"""WITH {_NEXUS} SELECT pid AS source, {_NODE.format(k='T', c='place')} AS target, 'perf_tower' AS type, perf_date AS date, CAST(NULL AS VARCHAR) AS bell FROM p
UNION ALL SELECT pid, {_NODE.format(k='M', c='method')}, 'perf_method', perf_date, NULL FROM p UNION ALL SELECT pid, {_NODE.format(k='R', c='name')}, 'perf_ringer', perf_date, bell FROM r""", "performances", "performance_ringers")
def nexus_links(c: Corpus) -> DataFrame:
    """The three kinds of links of a performance: to its tower, its method and its ringers with their bells."""
    perfs, ringers = _nexus(c)
    node = lambda kind, col: F.concat(F.lit(f"{kind}_"), F.coalesce(col, F.lit("None"))).alias("target")
    link = lambda df, kind, col, name, bell: df.select(F.col("pid").alias("source"), node(kind, col), F.lit(name).alias("type"), F.col("perf_date").alias("date"), bell.alias("bell"))
    none = F.lit(None).cast("string")
    return link(perfs, "T", "place", "perf_tower", none).union(link(perfs, "M", "method", "perf_method", none)).union(link(ringers, "R", "name", "perf_ringer", F.col("bell")))


@over(f"""WITH {_NEXUS}, l AS (SELECT {_NODE.format(k='T', c='place')} AS id, 'tower' AS kind FROM p UNION ALL SELECT {_NODE.format(k='M', c='method')}, 'method' FROM p UNION ALL SELECT {_NODE.format(k='R', c='name')}, 'ringer' FROM r)
SELECT id, kind, CASE kind WHEN 'ringer' THEN 2 + CAST(0.2 AS DOUBLE) * count(*) ELSE 3 + CAST(0.5 AS DOUBLE) * count(*) END AS val FROM l GROUP BY id, kind UNION ALL SELECT pid, 'performance', 1.0::DOUBLE FROM p""", "performances", "performance_ringers")
def nexus_vertices(c: Corpus) -> DataFrame:
    """The four kinds of nodes with their weights: 1, or 3 and half a link, or 2 and a fifth of a link."""
    kinds = {"perf_tower": ("tower", 3, 0.5), "perf_method": ("method", 3, 0.5), "perf_ringer": ("ringer", 2, 0.2)}
    ends = nexus_links(c).groupBy(F.col("target").alias("id"), "type").agg(F.count("*").alias("n"))
    kind, val = F.lit(None).cast("string"), F.lit(None).cast("double")
    for link, (name, least, each) in kinds.items():
        kind, val = F.when(F.col("type") == link, name).otherwise(kind), F.when(F.col("type") == link, least + each * F.col("n")).otherwise(val)
    return ends.select("id", kind.alias("kind"), val.alias("val")).union(_nexus(c)[0].select("pid", F.lit("performance"), F.lit(1.0)))


_DEBUTS = """d AS (SELECT method_id, arg_min({'date': perf_date, 'town': town, 'county': county, 'society': society}, concat(perf_date, '|', lpad(CAST(position AS STRING), 5, '0'), '|', coalesce(town, ''), '|', coalesce(building, ''))) AS e FROM method_performances WHERE perf_date <> '' GROUP BY method_id)"""
#: Debuts of a batch day.
BATCH = 3


def _debuts(c: Corpus) -> DataFrame:
    """method_id, date, town, county and society of each method's own earliest dated event; ties by position, town and building, then the first row of the source."""
    none = F.lit("")
    order = F.concat_ws("|", "perf_date", F.coalesce(F.lpad(F.col("position").cast("string"), 5, "0"), none), F.coalesce("town", none), F.coalesce("building", none))
    event = F.struct(F.col("perf_date").alias("date"), "town", "county", "society")
    first = c.with_place("method_performances").where("perf_date <> ''").groupBy("method_id").agg(F.min_by(event, F.struct(order, "place")).alias("e"))
    return first.select("method_id", "e.*")


@over(f"WITH {_DEBUTS} SELECT e.date AS date, count(*) AS methods, mode(e.society ORDER BY e.society) AS society FROM d GROUP BY 1 HAVING count(*) >= {BATCH}", "method_performances")
def debut_batch_days(c: Corpus) -> DataFrame:
    """Days that introduced BATCH methods or more, with the society of most of them."""
    debuts = _debuts(c)
    society = A.most_common(debuts.where("society IS NOT NULL"), ["date"], "society").select("date", "society")
    return debuts.groupBy("date").agg(F.count("*").alias("methods")).where(F.col("methods") >= BATCH).join(society, "date", "left")


@over(f"WITH {_DEBUTS} SELECT 'place' AS kind, e.town AS name, e.county AS county, count(*) AS methods FROM d GROUP BY ALL UNION ALL SELECT 'society', e.society, NULL, count(*) FROM d GROUP BY ALL", "method_performances")
def debut_places(c: Corpus) -> DataFrame:
    """Methods by the place and by the society of their debut, each method once."""
    debuts = _debuts(c)
    places = debuts.groupBy("town", "county").agg(F.count("*").alias("methods")).select(F.lit("place").alias("kind"), F.col("town").alias("name"), "county", "methods")
    return places.union(debuts.groupBy("society").agg(F.count("*").alias("methods")).select(F.lit("society"), "society", F.lit(None).cast("string"), "methods"))
