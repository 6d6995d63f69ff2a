"""The fifty statements over the performance corpus (Q01-Q50), on the bridged tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.dialect import band, duration_minutes, filled, muffled, tenor_weight, truth_sum, weekday
from loomspark.operators.views import performance_methods_view
from loomspark.plans.bridge import Corpus, oracle
from loomspark.plans.registry import recorded

#: The order of a statement's rows, where it states one.
ORDERS: dict[str, str] = {}


def row_count() -> Column:
    return F.count("*")


FIRST, LAST = "2021-01-01", "2024-12-31"


def ordered(df: DataFrame, order: str) -> DataFrame:
    """`df` in the statement's own order, such as 'd, -n'; a tie goes by the other columns, so the order is one."""
    asked = [x.strip() for x in order.split(",")]
    rest = [c for c in df.columns if c not in [x.lstrip("-") for x in asked]]
    return df.orderBy(*[F.desc(x[1:]) if x.startswith("-") else F.asc(x) for x in asked], *rest)


def over(statement: str, *tables: str, order: str = "") -> Callable:
    """Record a function of a corpus, with its oracle over the tables named and the order of its rows, if it has one."""
    def put(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return ordered(f(Corpus(spark, folder)), order) if order else f(Corpus(spark, folder))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        if order:
            ORDERS[f.__name__] = order
        recorded(oracle(statement, *tables))(run)
        return f

    return put


def tower_peals(c: Corpus) -> DataFrame:
    return c.method_performances.where("event_type = 'firstTowerbellPeal'")


def dated(events: DataFrame) -> DataFrame:
    return events.where("perf_date IS NOT NULL AND perf_date <> ''")


def share(part: Column, whole: Column) -> Column:
    return 100.0 * part / whole


@over("SELECT Tower_ID, Latitude, Longitude, founder_group, Cast_Date FROM bells JOIN founders ON Founder = Name WHERE founder_group IS NOT NULL AND Latitude IS NOT NULL", "bells", "founders")
def q01_bells_by_group(c: Corpus) -> DataFrame:
    """Each attributed bell with a place."""
    owned = c.founders.where("founder_group IS NOT NULL").select(F.col("Name").alias("Founder"), "founder_group")
    return c.bells.where("Latitude IS NOT NULL").join(owned, "Founder").select("Tower_ID", "Latitude", "Longitude", "founder_group", "Cast_Date")


@over("""
SELECT founder_group, count(DISTINCT e.method_id) AS methods_first_rung
FROM method_performances e JOIN towers_unique u ON u.TowerID = e.dove_tower_id JOIN bells b ON b.Tower_ID = u.TowerID JOIN founders f ON f.Name = b.Founder
WHERE e.event_type = 'firstTowerbellPeal' AND founder_group IS NOT NULL GROUP BY founder_group""", "method_performances", "towers_unique", "bells", "founders", order="-methods_first_rung")
def q02_first_peals_by_group(c: Corpus) -> DataFrame:
    """Methods first rung on a group's bells; a method counts for every group that has a bell there."""
    groups = c.founders.where("founder_group IS NOT NULL").select(F.col("Name").alias("Founder"), "founder_group")
    makers = c.bells.join(groups, "Founder").select(F.col("Tower_ID").alias("TowerID"), "founder_group").distinct()
    rung = tower_peals(c).select(F.col("dove_tower_id").alias("TowerID"), "method_id").distinct()
    return rung.join(c.towers_unique.select("TowerID"), "TowerID").join(makers, "TowerID").groupBy("founder_group").agg(F.count_distinct("method_id").alias("methods_first_rung"))


@over("SELECT min(from_year) AS first_year, max(to_year) AS last_year, count(*) AS firms, CAST(sum(Bells) AS BIGINT) AS bells_attributed FROM founders WHERE founder_group = 'Group 1'", "founders")
def q03_group_metadata(c: Corpus) -> DataFrame:
    """Span, firms and bells of one group, given as a parameter."""
    return c.spark.sql(
        "SELECT min(from_year) AS first_year, max(to_year) AS last_year, count(*) AS firms, sum(Bells) AS bells_attributed FROM {f} WHERE founder_group = :g",
        args={"g": "Group 1"}, f=c.founders,
    )


@over("SELECT Location FROM founders WHERE founder_group = 'Group 1' AND Location IS NOT NULL GROUP BY Location ORDER BY count(*) DESC, Location LIMIT 1", "founders")
def q04_group_home(c: Corpus) -> DataFrame:
    """Home town of a group: the most common one, ties by name."""
    homes = c.founders.where("founder_group = 'Group 1' AND Location IS NOT NULL").groupBy("Location").agg(row_count().alias("n"))
    return homes.orderBy(F.desc("n"), "Location").limit(1).select("Location")


@over("SELECT count(*) AS methods FROM methods", "methods")
def q05_methods(c: Corpus) -> DataFrame:
    return c.methods.agg(row_count().alias("methods"))


@over("SELECT count(*) AS tower_linked FROM method_performances WHERE dove_tower_id IS NOT NULL", "method_performances")
def q06_linked_events(c: Corpus) -> DataFrame:
    return c.method_performances.where("dove_tower_id IS NOT NULL").agg(row_count().alias("tower_linked"))


@over("SELECT count(*) AS unlinked FROM method_performances WHERE dove_tower_id IS NULL", "method_performances")
def q07_unlinked_events(c: Corpus) -> DataFrame:
    return c.method_performances.where("dove_tower_id IS NULL").agg(row_count().alias("unlinked"))


@over("""
SELECT DISTINCT 'dove' AS source_table, TowerID, Dedicn, BareDedicn, Place, Place2, PlaceCL, AltName, County, Country FROM dove WHERE coalesce(Dedicn, Place) IS NOT NULL
UNION ALL SELECT DISTINCT 'towers', TowerID, Dedicn, BareDedicn, Place, Place2, PlaceCL, AltName, County, Country FROM towers WHERE coalesce(Dedicn, Place) IS NOT NULL""", "dove", "towers")
def q08_lexicon_input(c: Corpus) -> DataFrame:
    """Distinct dedications and places of both registers, one after the other."""
    columns = ["TowerID", "Dedicn", "BareDedicn", "Place", "Place2", "PlaceCL", "AltName", "County", "Country"]
    part = lambda df, name: df.where("Dedicn IS NOT NULL OR Place IS NOT NULL").select(F.lit(name).alias("source_table"), *columns).distinct()
    return part(c.dove, "dove").unionByName(part(c.towers, "towers"))


@over("""
SELECT count(*) AS total_methods, count(DISTINCT name) AS distinct_names,
  count(DISTINCT method_id) FILTER (WHERE extension_construction <> '') AS labeled_methods,
  count(DISTINCT method_id) FILTER (WHERE stage % 2 = 0) AS even_stage_methods, count(DISTINCT method_id) FILTER (WHERE stage % 2 = 1) AS odd_stage_methods,
  min(stage) AS min_stage, max(stage) AS max_stage FROM methods""", "methods")
def q09_lineage_stats(c: Corpus) -> DataFrame:
    of = lambda condition: F.count_distinct(F.when(condition, F.col("method_id")))
    return c.methods.agg(
        row_count().alias("total_methods"), F.count_distinct("name").alias("distinct_names"), of(F.col("extension_construction") != "").alias("labeled_methods"),
        of(F.col("stage") % 2 == 0).alias("even_stage_methods"), of(F.col("stage") % 2 == 1).alias("odd_stage_methods"), F.min("stage").alias("min_stage"), F.max("stage").alias("max_stage"),
    )


_FAMILY = ["method_id", "name", "title", "stage", "notation", "symmetry", "lead_head", "lead_head_code", "length_of_lead", "number_of_hunts", "huntbell_path", "extension_construction"]
_FOUR = "event_type IN ('firstTowerbellPeal', 'firstInclusionInTowerbellPeal', 'firstPerformance', 'firstHandbellPeal')"


@over(f"""
WITH earliest AS (
  SELECT DISTINCT ON (method_id) method_id, perf_date, town, building, society, dove_tower_id FROM method_performances
  WHERE {_FOUR} AND perf_date IS NOT NULL ORDER BY method_id, perf_date, town, building, society, dove_tower_id NULLS FIRST
)
SELECT {', '.join('m.' + x for x in _FAMILY)}, coalesce(classification, 'Principle') AS classification, e.perf_date AS first_date, e.town AS first_town,
  e.building AS first_building, e.society AS first_society, e.dove_tower_id AS first_tower_id
FROM methods m LEFT JOIN earliest e ON e.method_id = m.method_id
WHERE (SELECT count(DISTINCT o.stage) FROM methods o WHERE o.name = m.name) > 1""", "methods", "method_performances", order="name, stage, method_id")
def q10_method_families(c: Corpus) -> DataFrame:
    """Methods whose name stands at several stages, with the earliest of four kinds of event; ties by all its values."""
    event = F.struct("perf_date", "town", "building", "society", "dove_tower_id")
    earliest = c.method_performances.where(f"{_FOUR} AND perf_date IS NOT NULL").groupBy("method_id").agg(F.min(event).alias("e"))
    names = c.methods.groupBy("name").agg(F.count_distinct("stage").alias("stages")).where("stages > 1").select("name")
    return c.methods.join(names, "name", "left_semi").join(earliest, "method_id", "left").select(
        *_FAMILY, F.coalesce("classification", F.lit("Principle")).alias("classification"), F.col("e.perf_date").alias("first_date"), F.col("e.town").alias("first_town"),
        F.col("e.building").alias("first_building"), F.col("e.society").alias("first_society"), F.col("e.dove_tower_id").alias("first_tower_id"),
    )


@over("SELECT r.perf_id, r.position, trim(r.name) AS name, p.perf_date, p.association, p.dove_tower_id, p.place FROM performance_ringers r JOIN performances p ON p.perf_id = r.perf_id WHERE trim(r.name) <> ''", "performance_ringers", "performances")
def q11_resolver_input(c: Corpus) -> DataFrame:
    return c.performance_ringers.where(filled(F.col("name"))).join(c.performances, "perf_id").select("perf_id", "position", F.trim("name").alias("name"), "perf_date", "association", "dove_tower_id", "place")


@over("""
SELECT m.method_id, title, name, stage, classification, cls_little AS little, d.debut
FROM methods m JOIN (SELECT method_id, min(perf_date) AS debut FROM method_performances WHERE perf_date <> '' GROUP BY method_id) d ON d.method_id = m.method_id""", "methods", "method_performances")
def q12_method_debuts(c: Corpus) -> DataFrame:
    """The first date of each method that has one; aggregated before the join, so nothing fans out."""
    debut = dated(c.method_performances).groupBy("method_id").agg(F.min("perf_date").alias("debut"))
    return c.methods.join(debut, "method_id").select("method_id", "title", "name", "stage", "classification", F.col("cls_little").alias("little"), "debut")


@over("SELECT (SELECT count(*) FROM methods) AS methods_total, (SELECT count(DISTINCT method_id) FROM method_performances WHERE perf_date <> '') AS with_a_debut_date", "methods", "method_performances")
def q13_debut_denominators(c: Corpus) -> DataFrame:
    return c.methods.agg(row_count().alias("methods_total")).join(dated(c.method_performances).agg(F.count_distinct("method_id").alias("with_a_debut_date")))


@over("SELECT method_id, perf_date AS debut_date, event_type, building, town, county, society, dove_tower_id FROM method_performances WHERE perf_date <> ''", "method_performances", order="method_id, debut_date")
def q14_dated_events(c: Corpus) -> DataFrame:
    return dated(c.method_performances).select("method_id", F.col("perf_date").alias("debut_date"), "event_type", "building", "town", "county", "society", "dove_tower_id")


@over("SELECT event_type, substr(perf_date, 1, 4) AS year, count(*) AS events FROM method_performances WHERE event_type ILIKE '%keyboard%' AND perf_date <> '' GROUP BY ALL", "method_performances", order="year, -events")
def q15_keyboard_events(c: Corpus) -> DataFrame:
    return dated(c.method_performances).where(F.col("event_type").ilike("%keyboard%")).groupBy("event_type", F.substring("perf_date", 1, 4).alias("year")).agg(row_count().alias("events"))


@over("""
SELECT count(*) AS events, CAST(sum(CASE WHEN e.perf_date = d.debut THEN 1 ELSE 0 END) AS BIGINT) AS debuts FROM method_performances e
LEFT JOIN (SELECT method_id, min(perf_date) AS debut FROM method_performances WHERE perf_date <> '' GROUP BY method_id) d ON d.method_id = e.method_id
WHERE town ILIKE '%ringing room%' OR building ILIKE '%ringing room%'""", "method_performances")
def q16_virtual_debuts(c: Corpus) -> DataFrame:
    """Events in virtual rooms and how many of them are the method's first; a correlated minimum as a grouped one."""
    debut = dated(c.method_performances).groupBy("method_id").agg(F.min("perf_date").alias("debut"))
    rooms = c.method_performances.where(F.col("town").ilike("%ringing room%") | F.col("building").ilike("%ringing room%"))
    return rooms.join(debut, "method_id", "left").agg(row_count().alias("events"), F.sum(F.when(F.col("perf_date") == F.col("debut"), 1).otherwise(0)).alias("debuts"))


@over("SELECT DISTINCT method_id FROM performance_methods", "performance_methods")
def q17_asserted_methods(c: Corpus) -> DataFrame:
    return c.performance_methods.select("method_id").distinct()


@over("SELECT perf_id, CAST(json_array_length(candidates) AS INT) AS candidates, candidates->>'$[0]' AS first_candidate FROM performance_method_unresolved WHERE candidates IS NOT NULL AND reason = 'spliced_count_mismatch'", "performance_method_unresolved")
def q18_refused_candidates(c: Corpus) -> DataFrame:
    """The candidates of refused rows, decoded from JSON."""
    found = F.from_json("candidates", "array<string>")
    return c.performance_method_unresolved.where("candidates IS NOT NULL AND reason = 'spliced_count_mismatch'").select("perf_id", F.size(found).alias("candidates"), found[0].alias("first_candidate"))


@over("SELECT p.perf_date, p.changes, f.footnote FROM performance_footnotes f JOIN performances p ON p.perf_id = f.perf_id WHERE f.footnote <> ''", "performance_footnotes", "performances")
def q19_footnotes_with_length(c: Corpus) -> DataFrame:
    return c.performance_footnotes.where("footnote <> ''").join(c.performances, "perf_id").select("perf_date", "changes", "footnote")


@over("""
SELECT count(*) AS footnotes, count(DISTINCT perf_id) AS performances_with_a_footnote, (SELECT count(*) FROM performances) AS performances_total
FROM performance_footnotes WHERE footnote <> ''""", "performance_footnotes", "performances")
def q20_footnote_denominators(c: Corpus) -> DataFrame:
    notes = c.performance_footnotes.where("footnote <> ''").agg(row_count().alias("footnotes"), F.count_distinct("perf_id").alias("performances_with_a_footnote"))
    return notes.join(c.performances.agg(row_count().alias("performances_total")))


@over(f"""
SELECT perf_date AS d, count(*) AS n, CAST(sum(CAST(ring_type = 'tower' AS INT)) AS BIGINT) AS n_tower, CAST(sum(CAST(ring_type = 'hand' AS INT)) AS BIGINT) AS n_hand,
  CAST(sum(CAST(changes >= 5000 AS INT)) AS BIGINT) AS n_peal, CAST(sum(CAST(changes >= 1250 AND changes < 5000 AS INT)) AS BIGINT) AS n_quarter,
  CAST(sum(CAST(method ILIKE '%tolling%' AS INT)) AS BIGINT) AS n_toll,
  CAST(sum(CAST(perf_id IN (SELECT f.perf_id FROM performance_footnotes f WHERE f.footnote ILIKE '%muffl%') AS INT)) AS BIGINT) AS n_muffled,
  count(DISTINCT dove_tower_id) AS n_towers
FROM performances WHERE perf_date BETWEEN '{FIRST}' AND '{LAST}' GROUP BY perf_date""", "performances", "performance_footnotes", order="d")
def q21_daily_profile(c: Corpus) -> DataFrame:
    """Nine measures a day; a performance with several muffled footnotes counts once."""
    quiet = c.performance_footnotes.where(muffled(F.col("footnote"))).select("perf_id").distinct().withColumn("quiet", F.lit(1))
    changes = F.col("changes")
    return c.performances.where(F.col("perf_date").between(FIRST, LAST)).join(quiet, "perf_id", "left").groupBy(F.col("perf_date").alias("d")).agg(
        row_count().alias("n"), truth_sum(F.col("ring_type") == "tower").alias("n_tower"), truth_sum(F.col("ring_type") == "hand").alias("n_hand"), truth_sum(changes >= 5000).alias("n_peal"),
        truth_sum((changes >= 1250) & (changes < 5000)).alias("n_quarter"), truth_sum(F.col("method").ilike("%tolling%")).alias("n_toll"),
        F.sum(F.coalesce("quiet", F.lit(0))).cast("long").alias("n_muffled"), F.count_distinct("dove_tower_id").alias("n_towers"),
    )


@over(f"SELECT perf_date AS d, footnote, count(*) AS n FROM performance_footnotes JOIN performances USING (perf_id) WHERE perf_date BETWEEN '{FIRST}' AND '{LAST}' GROUP BY ALL HAVING count(*) >= 3", "performances", "performance_footnotes", order="d, -n")
def q22_day_footnotes(c: Corpus) -> DataFrame:
    days = c.performances.where(F.col("perf_date").between(FIRST, LAST)).select("perf_id", F.col("perf_date").alias("d"))
    return c.performance_footnotes.join(days, "perf_id").groupBy("d", "footnote").agg(row_count().alias("n")).where("n >= 3")


@over(f"SELECT count(*) AS performances, count(DISTINCT perf_date) AS days, count(DISTINCT dove_ring_id) AS rings FROM performances WHERE perf_date BETWEEN '{FIRST}' AND '{LAST}'", "performances")
def q23_window_totals(c: Corpus) -> DataFrame:
    return c.performances.where(F.col("perf_date").between(FIRST, LAST)).agg(row_count().alias("performances"), F.count_distinct("perf_date").alias("days"), F.count_distinct("dove_ring_id").alias("rings"))


@over("SELECT count(DISTINCT f.perf_id) * 1.0 / (SELECT count(*) FROM performances) AS rate FROM performance_footnotes f SEMI JOIN performances p ON p.perf_id = f.perf_id WHERE footnote ILIKE '%muffl%'", "performances", "performance_footnotes")
def q24_muffled_base_rate(c: Corpus) -> DataFrame:
    """The muffled share of the whole corpus, not of the window."""
    quiet = c.performance_footnotes.where(muffled(F.col("footnote"))).join(c.performances, "perf_id", "left_semi").agg(F.count_distinct("perf_id").alias("quiet"))
    return quiet.join(c.performances.agg(row_count().alias("n"))).select((F.col("quiet").cast("double") / F.col("n")).alias("rate"))


@over(f"SELECT method, perf_date AS d, count(*) AS n FROM performances WHERE method ILIKE '%tolling%' AND perf_date BETWEEN '{FIRST}' AND '{LAST}' GROUP BY ALL", "performances", order="-n")
def q25_toll_candidates(c: Corpus) -> DataFrame:
    return c.performances.where(F.col("method").ilike("%tolling%") & F.col("perf_date").between(FIRST, LAST)).groupBy("method", F.col("perf_date").alias("d")).agg(row_count().alias("n"))


@over("""
SELECT u.TowerID, Place, Dedicn, count(*) AS first_peals FROM method_performances e JOIN towers_unique u ON u.TowerID = e.dove_tower_id
WHERE event_type = 'firstTowerbellPeal' GROUP BY ALL ORDER BY first_peals DESC, u.TowerID LIMIT 20""", "method_performances", "towers_unique")
def q26_busiest_towers(c: Corpus) -> DataFrame:
    """The 20 towers with most first peals, ties by tower; counted before the tower's names join."""
    counts = tower_peals(c).groupBy(F.col("dove_tower_id").alias("TowerID")).agg(row_count().alias("first_peals"))
    return counts.join(c.towers_unique.select("TowerID", "Place", "Dedicn"), "TowerID").orderBy(F.desc("first_peals"), "TowerID").limit(20)


@over("""
WITH peals AS (
  SELECT r.name AS conductor,
    CAST(p.changes AS DOUBLE) / (TRY_CAST(split_part(duration, 'h', 1) AS INT) * 60 + TRY_CAST(trim(split_part(duration, 'h', 2)) AS INT)) AS cpm,
    TRY_CAST(split_part(tenor, '-', 1) AS DOUBLE) + TRY_CAST(split_part(tenor, '-', 2) AS DOUBLE) / 4 + TRY_CAST(split_part(tenor, '-', 3) AS DOUBLE) / 112 AS cwt
  FROM performances p JOIN performance_ringers r ON r.perf_id = p.perf_id
  WHERE conductor = 1 AND ring_type = 'tower' AND changes > 5000 AND duration LIKE '%h%' AND duration NOT LIKE '%m%' AND tenor LIKE '%-%-%'
), banded AS (SELECT * FROM peals WHERE cwt >= 10 AND cwt < 16 AND cpm > 10 AND cpm < 60
), per AS (SELECT conductor, avg(cpm) AS mean_cpm FROM banded GROUP BY conductor HAVING count(*) >= 20)
SELECT (SELECT count(*) FROM banded) AS peals_measured, count(*) AS conductors, round((SELECT avg(cpm) FROM banded), 2) AS corpus_mean_cpm,
  round(max(mean_cpm), 2) AS fastest_conductor_mean, round(min(mean_cpm), 2) AS slowest_conductor_mean, round(max(mean_cpm) - min(mean_cpm), 2) AS spread_cpm FROM per""", "performances", "performance_ringers")
def q27_conductor_speed(c: Corpus) -> DataFrame:
    """Spread of conductors' mean speeds in one weight class; no names in the result."""
    long = c.performances.where("ring_type = 'tower' AND changes > 5000").where(F.col("duration").ilike("%h%") & ~F.col("duration").ilike("%m%") & F.col("tenor").like("%-%-%"))
    timed = long.select("perf_id", (F.col("changes").cast("double") / duration_minutes(F.col("duration"))).alias("cpm"), tenor_weight(F.col("tenor")).alias("cwt"))
    some = timed.where("cwt >= 10 AND cwt < 16 AND cpm > 10 AND cpm < 60").join(c.performance_ringers.where("conductor = 1").select("perf_id", "name"), "perf_id")
    each = some.groupBy("name").agg(row_count().alias("peals"), F.sum("cpm").alias("sum"), F.avg("cpm").alias("mean"))
    kept = F.col("peals") >= 20
    mean = lambda f: f(F.when(kept, F.col("mean")))
    return each.agg(
        F.coalesce(F.sum("peals"), F.lit(0)).alias("peals_measured"), F.count(F.when(kept, 1)).alias("conductors"), F.round(F.sum("sum") / F.sum("peals"), 2).alias("corpus_mean_cpm"),
        F.round(mean(F.max), 2).alias("fastest_conductor_mean"), F.round(mean(F.min), 2).alias("slowest_conductor_mean"), F.round(mean(F.max) - mean(F.min), 2).alias("spread_cpm"),
    )


@over("SELECT method, perf_date, count(*) AS n FROM performances WHERE regexp_matches(method, '^[0-9]') AND method ILIKE '%tolling%' GROUP BY ALL HAVING count(*) >= 3", "performances", order="-n")
def q28_counted_tolls(c: Corpus) -> DataFrame:
    """Tolls that begin with a number, rung at least three times in a day."""
    return c.performances.where(F.col("method").rlike("^[0-9]") & F.col("method").ilike("%tolling%")).groupBy("method", "perf_date").agg(row_count().alias("n")).where("n >= 3")


@over("SELECT concat(substr(perf_date, 1, 3), '0s') AS decade, count(*) AS first_peals FROM method_performances WHERE event_type = 'firstTowerbellPeal' AND regexp_matches(perf_date, '^[0-9]{4}-') GROUP BY decade", "method_performances", order="decade")
def q29_first_peals_by_decade(c: Corpus) -> DataFrame:
    return tower_peals(c).where(F.col("perf_date").rlike("^[0-9]{4}-")).groupBy(F.concat(F.substring("perf_date", 1, 3), F.lit("0s")).alias("decade")).agg(row_count().alias("first_peals"))


@over("""
SELECT Founder, count(DISTINCT method_id) AS methods_first_rung, count(DISTINCT TowerID) AS towers
FROM method_performances e JOIN towers_unique u ON u.TowerID = e.dove_tower_id JOIN bells b ON b.Tower_ID = u.TowerID
WHERE event_type = 'firstTowerbellPeal' AND Founder IS NOT NULL GROUP BY Founder ORDER BY methods_first_rung DESC, Founder LIMIT 20""", "method_performances", "towers_unique", "bells")
def q30_founder_reach(c: Corpus) -> DataFrame:
    rung = tower_peals(c).select(F.col("dove_tower_id").alias("TowerID"), "method_id").distinct().join(c.towers_unique.select("TowerID"), "TowerID")
    makers = c.bells.where("Founder IS NOT NULL").select(F.col("Tower_ID").alias("TowerID"), "Founder").distinct()
    reach = rung.join(makers, "TowerID").groupBy("Founder").agg(F.count_distinct("method_id").alias("methods_first_rung"), F.count_distinct("TowerID").alias("towers"))
    return reach.orderBy(F.desc("methods_first_rung"), "Founder").limit(20)


@over("""
SELECT (SELECT count(*) FROM performances) AS performances, count(DISTINCT perf_id) AS with_a_method_link, count(*) AS method_links,
  (SELECT count(*) FROM performance_method_unresolved) AS unresolved FROM performance_methods""", "performances", "performance_methods", "performance_method_unresolved")
def q31_linkage_coverage(c: Corpus) -> DataFrame:
    links = c.performance_methods.agg(F.count_distinct("perf_id").alias("with_a_method_link"), row_count().alias("method_links"))
    return c.performances.agg(row_count().alias("performances")).join(links).join(c.performance_method_unresolved.agg(row_count().alias("unresolved")))


@over("SELECT confidence, count(*) AS links, count(DISTINCT perf_id) AS performances FROM performance_methods GROUP BY confidence", "performance_methods", order="-links")
def q32_links_by_confidence(c: Corpus) -> DataFrame:
    return c.performance_methods.groupBy("confidence").agg(row_count().alias("links"), F.count_distinct("perf_id").alias("performances"))


@over("SELECT reason, count(*) AS performances FROM performance_method_unresolved GROUP BY reason", "performance_method_unresolved", order="-performances")
def q33_unresolved_by_reason(c: Corpus) -> DataFrame:
    return c.performance_method_unresolved.groupBy("reason").agg(row_count().alias("performances"))


@over("SELECT found_n - expected_n AS methods_off, count(*) AS performances FROM performance_method_unresolved WHERE reason = 'spliced_count_mismatch' AND expected_n IS NOT NULL GROUP BY 1", "performance_method_unresolved", order="-performances")
def q34_methods_off(c: Corpus) -> DataFrame:
    rows = c.performance_method_unresolved.where("reason = 'spliced_count_mismatch' AND expected_n IS NOT NULL")
    return rows.groupBy((F.col("found_n") - F.col("expected_n")).alias("methods_off")).agg(row_count().alias("performances"))


@over("""
WITH placed AS (
  SELECT method_id, title, County AS county FROM performance_methods JOIN performances USING (perf_id) JOIN towers_unique ON TowerID = dove_tower_id JOIN methods USING (method_id) WHERE County <> ''
), counted AS (SELECT method_id, title, county, count(*) AS county_perfs, CAST(sum(count(*)) OVER (PARTITION BY method_id) AS BIGINT) AS total_perfs FROM placed GROUP BY method_id, title, county)
SELECT title AS method, county AS dominant_county, county_perfs, total_perfs, round(100.0 * county_perfs / total_perfs, 1) AS concentration_pct
FROM counted WHERE total_perfs >= 50 AND 100.0 * county_perfs / total_perfs > 50""", "performance_methods", "performances", "towers_unique", "methods", order="-concentration_pct")
def q35_method_regionalism(c: Corpus) -> DataFrame:
    """Counties with over half of a method's performances, of at least 50."""
    placed = c.performance_methods.join(c.performances.select("perf_id", "dove_tower_id"), "perf_id").join(c.towers_unique.where("County <> ''").select(F.col("TowerID").alias("dove_tower_id"), F.col("County").alias("dominant_county")), "dove_tower_id")
    counts = placed.groupBy("method_id", "dominant_county").agg(row_count().alias("county_perfs")).withColumn("total_perfs", F.sum("county_perfs").over(Window.partitionBy("method_id")))
    pct = share(F.col("county_perfs"), F.col("total_perfs"))
    return counts.where((F.col("total_perfs") >= 50) & (pct > 50)).join(c.methods.select("method_id", F.col("title").alias("method")), "method_id").select("method", "dominant_county", "county_perfs", "total_perfs", F.round(pct, 1).alias("concentration_pct"))


@over("""
SELECT method_id, title AS method_title, stage, classification, count(*) AS performances, CAST(sum(CAST(changes >= 5000 AS INT)) AS BIGINT) AS peals, min(perf_date) AS first_seen, count(DISTINCT dove_tower_id) AS rings
FROM performance_methods JOIN performances USING (perf_id) JOIN methods USING (method_id) WHERE confidence <> 'low' GROUP BY ALL ORDER BY performances DESC, method_id LIMIT 25""", "performance_methods", "performances", "methods")
def q36_most_rung_methods(c: Corpus) -> DataFrame:
    view = performance_methods_view(c.performance_methods, c.performances, c.methods)
    rung = view.groupBy("method_id", "method_title", "stage", "classification").agg(
        row_count().alias("performances"), truth_sum(F.col("changes") >= 5000).alias("peals"), F.min("perf_date").alias("first_seen"), F.count_distinct("dove_tower_id").alias("rings"))
    return rung.orderBy(F.desc("performances"), "method_id").limit(25)


@over("""
SELECT stage, count(*) AS methods_in_library, CAST(sum(CASE WHEN method_id IN (SELECT method_id FROM performance_methods) THEN 0 ELSE 1 END) AS BIGINT) AS never_rung
FROM methods WHERE stage BETWEEN 4 AND 12 GROUP BY stage""", "methods", "performance_methods", order="stage")
def q37_never_rung(c: Corpus) -> DataFrame:
    """Methods of each stage without any link, whatever its confidence."""
    rung = c.performance_methods.select("method_id").distinct().withColumn("rung", F.lit(1))
    return c.methods.where(F.col("stage").between(4, 12)).join(rung, "method_id", "left").groupBy("stage").agg(row_count().alias("methods_in_library"), F.sum(F.when(F.col("rung").isNull(), 1).otherwise(0)).alias("never_rung"))


@over("""
SELECT CAST(10 * least(floor(10.0 * peals / appearances), 9) AS BIGINT) AS peal_share_band_pct, count(*) AS ringers, CAST(sum(appearances) AS BIGINT) AS appearances_in_band
FROM (SELECT trim(name) AS ringer, count(*) AS appearances, sum(CASE WHEN changes >= 5000 THEN 1 ELSE 0 END) AS peals FROM performance_ringers JOIN performances USING (perf_id)
  WHERE trim(name) <> '' AND changes IS NOT NULL GROUP BY ringer HAVING count(*) >= 50) GROUP BY 1""", "performance_ringers", "performances", order="peal_share_band_pct")
def q38_peal_share_bands(c: Corpus) -> DataFrame:
    """Ringers by the share of peals in their appearances, in bands of ten per cent, the last one closed."""
    rung = c.performance_ringers.where(filled(F.col("name"))).join(c.performances.where("changes IS NOT NULL").select("perf_id", "changes"), "perf_id")
    each = rung.groupBy(F.trim("name").alias("ringer")).agg(row_count().alias("appearances"), F.sum(F.when(F.col("changes") >= 5000, 1).otherwise(0)).alias("peals")).where("appearances >= 50")
    return each.groupBy((10 * band(F.col("peals") / F.col("appearances"))).cast("long").alias("peal_share_band_pct")).agg(row_count().alias("ringers"), F.sum("appearances").alias("appearances_in_band"))


def stated_night(practice: Column, days: int) -> Column:
    """1 for a practice on Monday to `days`, null if none is stated, it alternates or is by arrangement."""
    clear = ~practice.ilike("%alt%") & ~practice.ilike("%arrangement%")
    found = F.coalesce(*[F.when(practice.ilike(f"{d}%"), F.lit(k)) for k, d in enumerate(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat")[:days], 1)])
    return F.when(clear, found)


def night_agreement(c: Corpus, performances: DataFrame, stated: DataFrame, last: int, total: str, on_night: str = "stated_night_perfs") -> DataFrame:
    """Stated against busiest weekday of each tower with 20 or more short performances on Monday to `last`."""
    days = performances.where("changes IS NULL OR changes < 5000").withColumn("dow", weekday(F.col("perf_date"))).where(F.col("dow").between(1, last))
    counts = days.groupBy(F.col("dove_tower_id").alias("TowerID"), "dow").agg(row_count().alias("n"))
    busiest = counts.groupBy("TowerID").agg(F.sum("n").alias(total), F.min_by("dow", F.struct(-F.col("n"), "dow")).alias("busiest_dow")).where(F.col(total) >= 20)
    on_day = counts.select("TowerID", F.col("dow").alias("stated_dow"), F.col("n").alias("on_day"))
    return stated.where("stated_dow IS NOT NULL").join(busiest, "TowerID").join(on_day, ["TowerID", "stated_dow"], "left").select(
        *[x for x in stated.columns if x != "stated_dow"], "stated_dow", "busiest_dow", total, F.coalesce("on_day", F.lit(0)).alias(on_night),
        F.round(share(F.coalesce("on_day", F.lit(0)), F.col(total)), 1).alias("stated_night_pct"), (F.col("stated_dow") == F.col("busiest_dow")).cast("int").alias("is_busiest"),
    )


def _night_sql(source: str, outer: str, inner: str, last: int, names: str, total: str, extra: str = "", on_night: str = "stated_night_perfs") -> str:
    cases = " ".join(f"WHEN Practice ILIKE '{d}%' THEN {k}" for k, d in enumerate(names.split(), 1))
    return f"""
WITH st AS (SELECT *, CASE WHEN {outer} THEN NULL {cases} END AS stated_dow FROM (SELECT TowerID, max(Place) AS Place, max(County) AS County, max(Practice) AS Practice, max(Dedicn) AS Dedicn FROM dove WHERE Practice <> '' {inner} GROUP BY TowerID)),
c AS (SELECT dove_tower_id AS t, CAST(dayofweek(CAST(perf_date AS DATE)) AS INT) AS dow, count(*) AS n FROM {source} WHERE dove_tower_id IS NOT NULL AND (changes IS NULL OR changes < 5000)
  AND dayofweek(CAST(perf_date AS DATE)) BETWEEN 1 AND {last} GROUP BY ALL),
b AS (SELECT t, CAST(sum(n) AS BIGINT) AS total, arg_min(dow, -n * 10 + dow) AS busiest_dow FROM c GROUP BY t HAVING sum(n) >= 20)
SELECT TowerID, Place, {extra} County, Practice, stated_dow, busiest_dow, total AS {total}, coalesce(c.n, 0) AS {on_night}, round(100.0 * coalesce(c.n, 0) / total, 1) AS stated_night_pct,
  CAST(stated_dow = busiest_dow AS INT) AS is_busiest
FROM st JOIN b ON b.t = TowerID LEFT JOIN c ON c.t = TowerID AND c.dow = stated_dow WHERE stated_dow IS NOT NULL"""


@over(_night_sql("performances JOIN towers_unique u ON u.TowerID = dove_tower_id", "Practice ILIKE '%alt%' OR Practice ILIKE '%arrangement%'", "", 6, "Mon Tue Wed Thu Fri Sat", "total_non_sun_perfs", "Dedicn,", "stated_day_perfs"), "performances", "towers_unique", "dove", order="-total_non_sun_perfs")
def q39_practice_night(c: Corpus) -> DataFrame:
    """Monday to Saturday, over performances with a known tower; the wording is judged on the tower's greatest value."""
    stated = c.dove.where("Practice <> ''").groupBy("TowerID").agg(*[F.max(x).alias(x) for x in ("Place", "Dedicn", "County", "Practice")])
    return night_agreement(c, c.tower_performances, stated.withColumn("stated_dow", stated_night(F.col("Practice"), 6)), 6, "total_non_sun_perfs", "stated_day_perfs")


WEEKNIGHTS = _night_sql("performances", "false", "AND Practice NOT ILIKE '%alt%' AND Practice NOT ILIKE '%arrangement%'", 5, "Mon Tue Wed Thu Fri", "total_weekday")


@over(WEEKNIGHTS, "performances", "dove", order="-total_weekday")
def q40_practice_weeknight(c: Corpus) -> DataFrame:
    """Monday to Friday, over all performances with a tower; the wording is judged row by row."""
    rows = c.dove.where("Practice <> ''").where(~F.col("Practice").ilike("%alt%") & ~F.col("Practice").ilike("%arrangement%"))
    stated = rows.groupBy("TowerID").agg(*[F.max(x).alias(x) for x in ("Place", "County", "Practice")])
    return night_agreement(c, c.performances.where("dove_tower_id IS NOT NULL"), stated.withColumn("stated_dow", stated_night(F.col("Practice"), 5)), 5, "total_weekday")


@over("""
WITH counted AS (SELECT trim(method) AS method, County AS county, count(*) AS county_perfs, CAST(sum(count(*)) OVER (PARTITION BY trim(method)) AS BIGINT) AS total_perfs
  FROM performances JOIN towers_unique ON TowerID = dove_tower_id WHERE trim(method) <> '' AND County <> '' GROUP BY trim(method), County)
SELECT method, county AS dominant_county, county_perfs, total_perfs, round(100.0 * county_perfs / total_perfs, 1) AS concentration_pct, CASE WHEN method IN (SELECT title FROM methods) THEN 'library method' ELSE 'not a library method' END AS kind
FROM counted WHERE total_perfs >= 50 AND 100.0 * county_perfs / total_perfs > 70""", "performances", "towers_unique", "methods", order="-concentration_pct")
def q41_regional_traditions(c: Corpus) -> DataFrame:
    """Strings with over 70 % of their performances in one county, and whether the library knows them."""
    placed = c.tower_performances.where(filled(F.col("method")) & (F.col("County") != ""))
    counts = placed.groupBy(F.trim("method").alias("method"), F.col("County").alias("dominant_county")).agg(row_count().alias("county_perfs")).withColumn("total_perfs", F.sum("county_perfs").over(Window.partitionBy("method")))
    known = c.methods.select(F.col("title").alias("method")).distinct().withColumn("known", F.lit(True))
    pct = share(F.col("county_perfs"), F.col("total_perfs"))
    kept = counts.where((F.col("total_perfs") >= 50) & (pct > 70)).withColumn("concentration_pct", F.round(pct, 1))
    return kept.join(known, "method", "left").withColumn("kind", F.when(F.col("known"), "library method").otherwise("not a library method")).drop("known")


@over("""
WITH tp AS (SELECT label AS practice, County AS county FROM performance_method_unresolved x JOIN performances p ON p.perf_id = x.perf_id JOIN towers_unique ON TowerID = dove_tower_id JOIN traditions t ON t.perf_id = x.perf_id
  WHERE label NOT IN ('unclassified', 'multiple_methods') AND County <> ''),
a AS (SELECT County AS county, count(*) AS county_total FROM performances JOIN towers_unique ON TowerID = dove_tower_id WHERE County <> '' GROUP BY 1),
p AS (SELECT practice, count(*) AS national_total FROM tp GROUP BY 1 HAVING count(*) >= 50)
SELECT practice, county, count(*) AS performances, county_total, round(100.0 * count(*) / county_total, 2) AS pct_of_county, national_total, round(100.0 * count(*) / national_total, 2) AS pct_of_national
FROM tp JOIN p USING (practice) JOIN a USING (county) WHERE county_total >= 500 GROUP BY practice, county, county_total, national_total""", "performance_method_unresolved", "performances", "towers_unique", "traditions", order="practice, -pct_of_county")
def q42_traditions_normalised(c: Corpus) -> DataFrame:
    """Practice by county of unresolved performances, against all output of the county and of the practice."""
    placed = c.tower_performances.where("County <> ''").select("perf_id", F.col("County").alias("county"))
    county = placed.groupBy("county").agg(row_count().alias("county_total")).where("county_total >= 500")
    labels = c.traditions.where(~F.col("label").isin("unclassified", "multiple_methods")).select("perf_id", F.col("label").alias("practice"))
    cells = placed.join(c.performance_method_unresolved.select("perf_id"), "perf_id", "left_semi").join(labels, "perf_id").groupBy("practice", "county").agg(row_count().alias("performances"))
    cells = cells.withColumn("national_total", F.sum("performances").over(Window.partitionBy("practice"))).where("national_total >= 50").join(county, "county")
    pct = lambda whole: F.round(share(F.col("performances"), F.col(whole)), 2)
    return cells.withColumn("pct_of_county", pct("county_total")).withColumn("pct_of_national", pct("national_total"))


_DATES = ("2021-11-14", "2022-11-13", "2023-11-12", "2024-11-10")


@over(f"""
SELECT perf_date, count(DISTINCT perf_id) AS performances, count(DISTINCT CASE WHEN footnote ILIKE '%muffl%' THEN perf_id END) AS muffled,
  round(100.0 * count(DISTINCT CASE WHEN footnote ILIKE '%muffl%' THEN perf_id END) / count(DISTINCT perf_id), 1) AS pct
FROM performances LEFT JOIN performance_footnotes USING (perf_id) WHERE perf_date IN {_DATES} GROUP BY perf_date""", "performances", "performance_footnotes", order="perf_date")
def q43_remembrance_muffled(c: Corpus) -> DataFrame:
    """Muffled performances on four dates; those without a footnote still count."""
    days = c.performances.where(F.col("perf_date").isin(*_DATES)).select("perf_id", "perf_date")
    return days.join(c.performance_footnotes, "perf_id", "left").groupBy("perf_date").agg(
        F.count_distinct("perf_id").alias("performances"), F.count_distinct(F.when(muffled(F.col("footnote")), F.col("perf_id"))).alias("muffled")
    ).withColumn("pct", F.round(share(F.col("muffled"), F.col("performances")), 1))


@over("SELECT round(100.0 * count(DISTINCT f.perf_id) / (SELECT count(*) FROM performances), 2) AS pct_muffled_overall FROM performance_footnotes f JOIN performances p ON p.perf_id = f.perf_id WHERE footnote ILIKE '%muffl%'", "performances", "performance_footnotes")
def q44_muffled_overall(c: Corpus) -> DataFrame:
    return q24_muffled_base_rate(c).select(F.round(100 * F.col("rate"), 2).alias("pct_muffled_overall"))


@over("""
WITH single AS (SELECT * FROM performance_ringers WHERE trim(bell) <> '' AND bell NOT LIKE '%-%'),
size AS (SELECT perf_id, count(*) AS bells FROM single GROUP BY perf_id),
a AS (SELECT trim(name) AS ringer, p.perf_id, perf_date, position, CAST(bell AS DOUBLE) / bells AS pos FROM single JOIN performances p USING (perf_id) JOIN size USING (perf_id)
  WHERE trim(name) <> '' AND regexp_matches(perf_date, '^[0-9]{4}') AND ring_type = 'tower' AND CAST(bell AS INT) BETWEEN 1 AND bells),
r AS (SELECT *, row_number() OVER (PARTITION BY ringer ORDER BY perf_date, perf_id, pos) AS rn, count(*) OVER (PARTITION BY ringer) AS n,
  max(CAST(substr(perf_date, 1, 4) AS INT)) OVER (PARTITION BY ringer) - min(CAST(substr(perf_date, 1, 4) AS INT)) OVER (PARTITION BY ringer) AS years FROM a),
b AS (SELECT ringer, avg(CASE WHEN rn <= n // 10 THEN pos END) AS early, avg(CASE WHEN rn > n - n // 10 THEN pos END) AS late, max(pos) - min(pos) AS span FROM r WHERE n >= 50 AND years >= 5 GROUP BY ringer)
SELECT count(*) AS cohort_ringers, round(avg(early), 3) AS mean_early_position, round(avg(late), 3) AS mean_late_position, round(avg(late) - avg(early), 3) AS mean_drift,
  count(*) FILTER (WHERE late - early > 0.05) AS moved_up, count(*) FILTER (WHERE late - early < -0.05) AS moved_down, count(*) FILTER (WHERE abs(late - early) <= 0.05) AS stayed,
  round(avg(span), 3) AS mean_within_ringer_range FROM b""", "performance_ringers", "performances")
def q45_ringing_careers(c: Corpus) -> DataFrame:
    """Place in the ring in the first and the last tenth of a career; ties in date by performance and place."""
    single = c.performance_ringers.where(filled(F.col("bell")) & ~F.col("bell").like("%-%"))
    size = single.groupBy("perf_id").agg(row_count().alias("bells"))
    tower = c.performances.where("ring_type = 'tower'").where(F.col("perf_date").rlike("^[0-9]{4}")).select("perf_id", "perf_date")
    rung = single.where(filled(F.col("name"))).join(tower, "perf_id").join(size, "perf_id").where(F.col("bell").try_cast("int").between(1, F.col("bells")))
    rung = rung.select(F.trim("name").alias("ringer"), "perf_id", "perf_date", (F.col("bell").try_cast("double") / F.col("bells")).alias("pos"), F.substring("perf_date", 1, 4).cast("int").alias("year"))
    career = Window.partitionBy("ringer")
    ranked = rung.select("ringer", "pos", F.row_number().over(career.orderBy("perf_date", "perf_id", "pos")).alias("rn"), row_count().over(career).alias("n"), (F.max("year").over(career) - F.min("year").over(career)).alias("years"))
    tenth = F.floor(F.col("n") / 10)
    each = ranked.where("n >= 50 AND years >= 5").groupBy("ringer").agg(
        F.avg(F.when(F.col("rn") <= tenth, F.col("pos"))).alias("early"), F.avg(F.when(F.col("rn") > F.col("n") - tenth, F.col("pos"))).alias("late"), (F.max("pos") - F.min("pos")).alias("span"))
    drift = F.col("late") - F.col("early")
    return each.agg(
        row_count().alias("cohort_ringers"), F.round(F.avg("early"), 3).alias("mean_early_position"), F.round(F.avg("late"), 3).alias("mean_late_position"), F.round(F.avg("late") - F.avg("early"), 3).alias("mean_drift"),
        F.count_if(drift > 0.05).alias("moved_up"), F.count_if(drift < -0.05).alias("moved_down"), F.count_if(F.abs(drift) <= 0.05).alias("stayed"), F.round(F.avg("span"), 3).alias("mean_within_ringer_range"),
    )


@over("SELECT County, count(*) AS bells FROM bells JOIN founders ON Name = Founder JOIN towers_unique ON TowerID = Tower_ID WHERE founder_group = 'Group 2' GROUP BY County ORDER BY bells DESC, County NULLS FIRST LIMIT 15", "bells", "founders", "towers_unique")
def q46_group_territory(c: Corpus) -> DataFrame:
    """Bells of one group by county: joined to one row a tower, so shared towers don't count twice."""
    own = c.founders.where("founder_group = 'Group 2'").select(F.col("Name").alias("Founder"))
    here = c.bells.join(own, "Founder").join(c.towers_unique.select(F.col("TowerID").alias("Tower_ID"), "County"), "Tower_ID")
    return here.groupBy("County").agg(row_count().alias("bells")).orderBy(F.desc("bells"), F.asc_nulls_first("County")).limit(15)


@over("""
SELECT perf_date, count(*) AS performances, CAST(sum(CAST(method ILIKE '%tolling%' AS INT)) AS BIGINT) AS tolling, count(DISTINCT dove_tower_id) AS rings
FROM performances WHERE perf_date LIKE '2022-09%' GROUP BY perf_date ORDER BY performances DESC, perf_date LIMIT 8""", "performances")
def q47_top_days_of_a_month(c: Corpus) -> DataFrame:
    days = c.performances.where(F.col("perf_date").startswith("2022-09")).groupBy("perf_date").agg(row_count().alias("performances"), truth_sum(F.col("method").ilike("%tolling%")).alias("tolling"), F.count_distinct("dove_tower_id").alias("rings"))
    return days.orderBy(F.desc("performances"), "perf_date").limit(8)


@over("""
SELECT count(*) AS all_september, count(*) FILTER (WHERE perf_date NOT BETWEEN '2022-09-08' AND '2022-09-19') AS excluding_that_week
FROM performances WHERE month(CAST(perf_date AS DATE)) = 9""", "performances")
def q48_month_without_a_range(c: Corpus) -> DataFrame:
    autumn = c.performances.where(F.month(F.try_to_date("perf_date", "yyyy-MM-dd")) == 9)
    return autumn.agg(row_count().alias("all_september"), F.count_if(~F.col("perf_date").between("2022-09-08", "2022-09-19")).alias("excluding_that_week"))


@over("SELECT CASE WHEN dove_tower_id IS NULL THEN 'unlinked' ELSE 'linked' END AS state, count(*) AS records FROM method_performances GROUP BY 1", "method_performances")
def q49_linked_or_not(c: Corpus) -> DataFrame:
    return c.method_performances.groupBy(F.when(F.col("dove_tower_id").isNull(), "unlinked").otherwise("linked").alias("state")).agg(row_count().alias("records"))


@over("SELECT building, town, county, count(*) AS records FROM method_performances WHERE dove_tower_id IS NULL GROUP BY ALL ORDER BY records DESC, building, town, county LIMIT 20", "method_performances")
def q50_top_unlinked_places(c: Corpus) -> DataFrame:
    places = c.method_performances.where("dove_tower_id IS NULL").groupBy("building", "town", "county").agg(row_count().alias("records"))
    return places.orderBy(F.desc("records"), "building", "town", "county").limit(20)
