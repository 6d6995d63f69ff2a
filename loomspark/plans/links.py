"""Resolvers on the bridged corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import lexicon, lineage, locate, resolve
from loomspark.plans.bridge import Corpus
from loomspark.plans.findings import over

_TITLES = "t AS (SELECT title, max(method_id) AS id FROM methods GROUP BY title)"


@over(f"""WITH {_TITLES} SELECT p.perf_id, t.id AS method_id, 0 AS ord, 'exact_title' AS match_kind, 'high' AS confidence FROM performances p JOIN t ON t.title = p.method""", "performances", "methods")
def method_links(c: Corpus) -> DataFrame:
    """Links; the bridged titles either match exactly or not at all."""
    performances = c.performances.select("perf_id", "method", F.lit(None).cast("string").alias("details"))
    return resolve.link_methods(performances, c.methods)[0].select("perf_id", "method_id", "ord", "match_kind", "confidence")


@over(f"""WITH {_TITLES} SELECT CASE WHEN method ILIKE '%tolling%' OR method ILIKE '%call changes%' THEN 'not_a_method' ELSE 'no_title_match' END AS reason, count(*) AS n
FROM performances WHERE coalesce(method, '') NOT IN (SELECT title FROM t) GROUP BY 1""", "performances", "methods")
def method_unresolved(c: Corpus) -> DataFrame:
    """What no method was found for, by reason."""
    performances = c.performances.select("perf_id", "method", F.lit(None).cast("string").alias("details"))
    return resolve.link_methods(performances, c.methods)[1].groupBy("reason").agg(F.count("*").alias("n"))


@over("SELECT trim(name) AS name, trim(name) AS canonical, count(*) AS total FROM performance_ringers WHERE trim(name) <> '' GROUP BY 1", "performance_ringers")
def name_people(c: Corpus) -> DataFrame:
    """R2: the bridged names differ in their last word, so each is a person."""
    rows = c.performance_ringers.join(c.performances.select("perf_id", "association", "dove_tower_id"), "perf_id")
    return resolve.resolve_names(rows).select("name", "canonical", "total")


@over("SELECT p.method_id AS parent_method_id, k.method_id AS child_method_id FROM methods p JOIN methods k ON p.name = k.name AND p.stage < k.stage", "methods")
def extension_pairs(c: Corpus) -> DataFrame:
    """The pairs that are judged; the verdicts are tested by hand."""
    return lineage.extensions(c.methods).select("parent_method_id", "child_method_id")


@over("""WITH r AS (SELECT Place AS term, 'place_name' AS domain FROM towers UNION ALL SELECT Dedicn, 'dedication' FROM towers)
SELECT domain, term AS raw_term, term AS canonical_term, 'verbatim' AS category, count(*) AS evidence_count FROM r GROUP BY ALL""", "towers")
def name_lexicon(c: Corpus) -> DataFrame:
    """Terms with their canonical spelling and evidence; the bridged ones are canonical already."""
    rows = c.towers.select(F.posexplode(F.array(F.struct(F.col("Place").alias("term"), F.lit("place_name").alias("domain")), F.struct(F.col("Dedicn").alias("term"), F.lit("dedication").alias("domain")))).alias("k", "t"), "RingID", "Place")
    terms = rows.select("t.term", "t.domain", F.col("Place").alias("example"), (2 * F.col("RingID") + F.col("k")).alias("seq"))
    return lexicon.lexicon(terms).where("domain <> 'saint_name'").select("domain", "raw_term", "canonical_term", "category", "evidence_count")


@over("""WITH e AS (SELECT DISTINCT concat('Place ', CAST(perf_id % 120 AS STRING)) AS town FROM performances), u AS (SELECT concat('place ', CAST(TowerID AS STRING)) AS k, TowerID FROM towers_unique)
SELECT town, TowerID AS dove_tower_id, CASE WHEN TowerID IS NULL THEN 'none' ELSE 'high' END AS confidence FROM e LEFT JOIN u ON u.k = lower(town)""", "performances", "towers_unique")
def place_towers(c: Corpus) -> DataFrame:
    """The tower of each town."""
    none = F.lit(None).cast("string")
    events = c.performances.select(none.alias("building"), F.concat(F.lit("Place "), (F.col("perf_id") % 120).cast("string")).alias("town"), none.alias("county"))
    return locate.locate(events, c.dove).select("town", "dove_tower_id", "confidence")
