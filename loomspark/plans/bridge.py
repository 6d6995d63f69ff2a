"""The performance corpus's tables, made from a star schema of the same shape.

orders stand for performances, lineitem for appearances and events, part for methods, customer
for rings, supplier for bells and nation for founders. Each table is one SELECT that Spark and
DuckDB read alike, with the source tables in braces; edge cases (null, empty, duplicate, malformed)
come from key arithmetic, and no row of a source is left out unless the statement's table has fewer.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.tables import table

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

TABLES = {
    "performances": """
SELECT o_orderkey AS perf_id, concat('Place ', CAST(o_custkey % 80 AS STRING)) AS place,
  CASE WHEN o_orderstatus = 'O' THEN 'hand' ELSE 'tower' END AS ring_type,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 110 END AS dove_tower_id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS dove_ring_id,
  CASE WHEN o_orderkey % 12 = 5 THEN '2023-05-06' WHEN o_orderkey % 12 = 7 THEN '2022-06-05' WHEN o_orderkey % 60 = 11 THEN '2022-09-19'
    ELSE CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL '9128' DAY AS DATE) AS STRING) END AS perf_date,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 5000 ELSE CAST(1000 + (o_orderkey * 37) % 6000 AS INT) END AS changes,
  CASE WHEN o_orderkey % 19 = 0 THEN '45m' ELSE concat(CAST(2 + o_orderkey % 2 AS STRING), 'h ', CAST(o_orderkey % 60 AS STRING)) END AS duration,
  CASE WHEN o_orderkey % 23 = 0 THEN '12 cwt' ELSE concat(CAST(8 + o_orderkey % 10 AS STRING), '-', CAST(o_orderkey % 4 AS STRING), '-', CAST(o_orderkey % 28 AS STRING)) END AS tenor,
  CASE o_orderkey % 7 WHEN 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN concat(CAST(70 + o_orderkey % 29 AS STRING), ' Tolling') ELSE concat(substr(CAST(o_orderdate AS STRING), 9, 2), ' Tolling') END
    WHEN 1 THEN 'Call Changes' WHEN 2 THEN ' ' WHEN 3 THEN NULL WHEN 4 THEN concat('County style ', CAST((o_custkey % 110) % 5 AS STRING))
    ELSE concat('small ring ', CAST(o_orderkey % 5 AS STRING)) END AS method,
  o_orderpriority AS association
FROM {orders}""",
    "performance_ringers": """
SELECT l_orderkey AS perf_id, l_linenumber AS position,
  CASE WHEN l_linenumber = 5 THEN '1-2' WHEN l_linenumber = 6 THEN '' ELSE CAST(l_linenumber AS STRING) END AS bell,
  CASE WHEN l_suppkey % 100 = 0 THEN ' ' WHEN l_suppkey % 100 = 1 THEN NULL ELSE concat(' Ringer ', CAST(l_suppkey % 60 AS STRING)) END AS name,
  CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS conductor
FROM {lineitem}""",
    "performance_footnotes": """
SELECT o_orderkey AS perf_id, 1 AS position,
  CASE o_orderkey % 5 WHEN 0 THEN 'Half-MUFFLED for the fallen' WHEN 1 THEN concat('First quarter: ', o_orderpriority) WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'Wedding of two friends' END AS footnote
FROM {orders}
UNION ALL
SELECT o_orderkey, 2, 'Rung fully muffled' FROM {orders} WHERE o_orderstatus = 'F'""",
    "methods": """
SELECT concat('m', CAST(p_partkey AS STRING)) AS method_id, CASE WHEN p_partkey <= 2 THEN concat('County style ', CAST(p_partkey AS STRING)) ELSE concat(p_name, ' ', CAST(p_size % 9 AS STRING)) END AS title,
  CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE concat(p_name, ' ', p_brand) END AS name, CAST(4 + p_size % 9 AS INT) AS stage,
  CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_type END AS classification, CAST(p_partkey % 2 AS INT) AS cls_little,
  concat('-', CAST(p_size AS STRING)) AS notation, CASE WHEN p_partkey % 3 = 0 THEN 'palindromic' END AS symmetry,
  CAST(p_size AS STRING) AS lead_head, substr(p_brand, 7, 1) AS lead_head_code, CAST(2 * p_size AS INT) AS length_of_lead,
  CAST(p_partkey % 3 AS INT) AS number_of_hunts, '1' AS huntbell_path, CASE WHEN p_partkey % 4 = 0 THEN '1BC' WHEN p_partkey % 4 = 1 THEN '' END AS extension_construction
FROM {part}""",
    "method_performances": """
SELECT concat('m', CAST(l_partkey AS STRING)) AS method_id, l_linenumber AS position,
  CASE l_linenumber % 4 WHEN 0 THEN 'firstTowerbellPeal' WHEN 1 THEN 'firstHandbellPeal' WHEN 2 THEN 'firstInclusionInTowerbellPeal' ELSE 'firstKeyboardPeal' END AS event_type,
  CASE WHEN l_orderkey % 29 = 0 THEN NULL WHEN l_orderkey % 31 = 0 THEN '' WHEN l_orderkey % 37 = 0 THEN '1777' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS perf_date,
  CASE WHEN l_suppkey % 15 = 0 THEN 'Virtual Ringing Room' ELSE concat('St ', CAST(l_suppkey AS STRING)) END AS building,
  concat('Town ', CAST(l_suppkey % 30 AS STRING)) AS town, concat('County ', CAST(l_suppkey % 12 AS STRING)) AS county, l_returnflag AS society,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey END AS dove_tower_id
FROM {lineitem}""",
    "performance_methods": """
SELECT perf_id, method_id, CASE min(flag) WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT l_orderkey AS perf_id, l_returnflag AS flag, CASE WHEN l_partkey % 10 < 3 THEN concat('m', CAST(1 + (o_custkey % 110) % 5 AS STRING)) ELSE concat('m', CAST(l_partkey AS STRING)) END AS method_id
  FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey) AS x GROUP BY perf_id, method_id""",
    "performance_method_unresolved": """
SELECT o_orderkey AS perf_id, CASE o_orderkey % 3 WHEN 0 THEN 'spliced_count_mismatch' WHEN 1 THEN 'no_title_match' ELSE 'ambiguous_title' END AS reason,
  CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE CAST(2 + o_orderkey % 5 AS INT) END AS expected_n, CAST(o_orderkey % 9 AS INT) AS found_n,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('["m', CAST(o_orderkey % 40 AS STRING), '","m1"]') END AS candidates
FROM {orders} WHERE o_orderstatus = 'P'""",
    "towers": """
SELECT c_custkey AS RingID, c_custkey % 100 AS TowerID, concat('Place ', CAST(c_custkey % 100 AS STRING)) AS Place, c_mktsegment AS Dedicn, c_mktsegment AS BareDedicn,
  CASE WHEN c_custkey % 4 = 0 THEN 'Upper' END AS Place2, concat('CL ', CAST(c_custkey % 100 AS STRING)) AS PlaceCL, CASE WHEN c_custkey % 6 = 0 THEN 'Old' END AS AltName,
  CASE WHEN c_custkey % 25 = 7 THEN NULL ELSE concat('County ', CAST(c_custkey % 5 AS STRING)) END AS County, concat('Country ', CAST(c_custkey % 2 AS STRING)) AS Country, c_acctbal AS Lat, c_acctbal / 3 AS Long,
  concat('D', CAST(c_custkey AS STRING)) AS DoveID, CASE WHEN c_custkey % 8 > 0 THEN concat('Region ', CAST(c_custkey % 3 AS STRING)) END AS Region, CASE WHEN c_custkey % 9 = 0 THEN 'Lightweight' ELSE 'Full-circle ring' END AS RingType,
  4 + c_custkey % 9 AS Bells, CASE WHEN c_custkey % 11 > 0 THEN concat(CAST(5 + c_custkey % 30 AS STRING), '-0-0') END AS Wt, CASE WHEN c_custkey % 4 = 0 THEN concat('https://example.org/', CAST(c_custkey AS STRING)) END AS WebPage,
  CASE c_custkey % 10 WHEN 0 THEN 'Mon' WHEN 1 THEN 'Tue 7.30' WHEN 2 THEN 'Wed (alt)' WHEN 3 THEN 'Thu' WHEN 4 THEN 'Fri by arrangement' WHEN 5 THEN 'Sat' WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN 'tue' ELSE 'Sun' END AS Practice
FROM {customer}""",
    "bells": """
SELECT s_suppkey AS Bell_ID, s_suppkey % 90 AS Tower_ID, CASE WHEN s_suppkey % 14 = 0 THEN NULL ELSE s_acctbal END AS Latitude, s_acctbal / 2 AS Longitude,
  CASE WHEN s_suppkey % 16 = 0 THEN NULL ELSE concat('Founder ', CAST(s_suppkey % 30 AS STRING)) END AS Founder, concat('c', CAST(1700 + s_suppkey % 300 AS STRING)) AS Cast_Date
FROM {supplier}""",
    "founders": """
SELECT concat('Founder ', CAST(n_nationkey AS STRING)) AS Name, 1500 + 10 * n_nationkey AS from_year, 1600 + 10 * n_nationkey AS to_year,
  CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE concat('Group ', CAST(n_regionkey * 3 + n_nationkey % 3 AS STRING)) END AS founder_group,
  CASE WHEN n_nationkey % 9 = 8 THEN NULL ELSE concat('Home ', CAST(n_nationkey % 3 AS STRING)) END AS Location, 7 * n_nationkey AS Bells
FROM {nation}""",
    "traditions": """
SELECT o_orderkey AS perf_id, CASE o_orderkey % 4 WHEN 0 THEN 'call_changes' WHEN 1 THEN 'tolling' WHEN 2 THEN 'unclassified' ELSE 'multiple_methods' END AS label FROM {orders}""",
}


class Corpus:
    """The tables of a folder, by name, each read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or name not in TABLES:
            raise AttributeError(name)
        made = self.spark.sql(TABLES[name], **{s: table(self.spark, self.folder, s) for s in SOURCES if f"{{{s}}}" in TABLES[name]})
        setattr(self, name, made)
        return made

    def with_place(self, name: str) -> DataFrame:
        """The table `name`, made of one source, with place: the file and the number in it of the row that a row is made of."""
        (source,) = [s for s in SOURCES if f"{{{s}}}" in TABLES[name]]
        rows = table(self.spark, self.folder, source).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
        return self.spark.sql(TABLES[name].replace(f"\nFROM {{{source}}}", f", place\nFROM {{{source}}}"), **{source: rows})

    @cached_property
    def dove(self) -> DataFrame:
        return self.towers

    @cached_property
    def towers_unique(self) -> DataFrame:
        from loomspark.operators.views import towers_unique

        return towers_unique(self.towers)

    @cached_property
    def tower_performances(self) -> DataFrame:
        from loomspark.operators.views import tower_performances

        return tower_performances(self.performances, self.towers_unique)


_DERIVED = {
    "towers_unique": "SELECT TowerID, max(Place) AS Place, max(Dedicn) AS Dedicn, max(County) AS County, max(Country) AS Country, max(Lat) AS Lat, max(Long) AS Long, count(*) AS installations FROM towers GROUP BY TowerID",
    "dove": "SELECT * FROM towers",
}
_NEEDS = {"towers_unique": ["towers"], "dove": ["towers"]}


def oracle(statement: str, *tables: str) -> str:
    """A DuckDB statement over the tables named, each a common table expression."""
    names: list[str] = []
    for t in tables:
        names += [x for x in (*_NEEDS.get(t, []), t) if x not in names]
    plain = {t: (TABLES.get(t) or _DERIVED[t]).format(**{s: s for s in SOURCES}) for t in names}
    own = ",\n".join(f"{t} AS ({sql.strip()})" for t, sql in plain.items())
    rest = statement.strip()
    return f"WITH {own}\n" + (f", {rest[5:]}" if rest.startswith("WITH ") else rest)
