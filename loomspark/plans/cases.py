"""Resolvers, classifiers and the kernel on cases whose answers are written down, each as often as the orders have its number.

The answers were found by hand from the rules, so an oracle here is a list of them and a count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import classify as K
from loomspark.operators import kernel, lexicon, lineage, locate, resolve
from loomspark.plans.kernel_queries import CALLS, MAJOR
from loomspark.plans.registry import recorded
from loomspark.sources.tables import table

_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows: list[tuple], columns: str) -> str:
    """A SELECT of the rows, numbered in k."""
    names = [c.split() for c in columns.split(", ")]
    lists = ", ".join("(" + ", ".join([str(k), *map(literal, r)]) + ")" for k, r in enumerate(rows))
    return f"SELECT k, {', '.join(f'CAST({n} AS {_TYPES[t]}) AS {n}' for n, t in names)} FROM (VALUES {lists}) v(k, {', '.join(n for n, _ in names)})"


def told(rows: list[tuple], asked: str, answers: str) -> Callable:
    """Record a function of a DataFrame of the asked columns; each case comes once for each order with its number."""
    width = len(asked.split(", "))

    def put(f: Callable[[DataFrame], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            cases = F.broadcast(spark.createDataFrame([(k, *r[:width]) for k, r in enumerate(rows)], f"k long, {asked}"))  # the cases are a fixed list
            numbered = table(spark, folder, "orders").select((F.col("o_orderkey") % len(rows)).alias("k")).join(cases, "k").drop("k")
            return f(numbered).groupBy(*[c.split()[0] for c in f"{asked}, {answers}".split(", ")]).agg(F.count("*").alias("n"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        names = ", ".join(c.split()[0] for c in f"{asked}, {answers}".split(", "))
        recorded(f"WITH c AS ({values(rows, f'{asked}, {answers}')}) SELECT {names}, count(*) AS n FROM c JOIN orders ON o_orderkey % {len(rows)} = k GROUP BY ALL")(run)
        return f

    return put


@told([
    ("3m Doubles", "multiple_methods"), ("99 Single Bell Tolling", "tolling"), ("Chiming", "tolling"), ("Call Changes and Rounds", "rounds_and_call_changes"), ("Callchanges", "call_changes"), ("C.C.s", "call_changes"), ("Call-Changes", "call_changes"),
    ("Rounds", "rounds"), ("April Day Doubles", "unclassified"), ("Cambridge and PB Minor", "multiple_methods"), ("Spliced Surprise Major", "multiple_methods"), ("Service Ringing", "general"), ("General Ringing", "general"), ("Mixed Doubles", "multiple_methods"),
    ("Plain Bob", "unclassified"), ("", "unclassified"), (None, "unclassified"),
], "method string", "practice string")
def practice_cases(df: DataFrame) -> DataFrame:
    """K-T1: all seven labels."""
    return df.withColumn("practice", K.practice(F.col("method")))


@told([
    ("", "none", "none", "high", "empty footnote"), (None, "none", "none", "high", "empty footnote"), ("Half-muffled for John Smith", "memorial", "person", "high", "Half-muffled"),
    ("For the funeral of Her Majesty the Queen", "civic", "person", "high", "Her Majesty / funeral"), ("Rung for Armistice, lest we forget", "civic", "institution", "high", "Armistice (lest we forget)"),
    ("Happy 70th birthday Ann", "birthday", "person", "high", "70th birthday"), ("Golden wedding", "wedding", "person", "high", "Golden wedding"), ("Centenary of the bells", "anniversary", "bells", "high", "Centenary"),
    ("Centenary of the Guild", "anniversary", "institution", "high", "Centenary"), ("For evensong", "seasonal", "none", "high", "evensong"), ("Congratulations to the new vicar", "compliment", "person", "high", "Congratulations to"),
    ("First quarter: 3", "first-performance", "none", "high", "First quarter"), ("First quarter on the new bells", "first-performance", "bells", "high", "First quarter"), ("Practice night", "practice", "none", "high", "Practice night"),
    ("Nothing special", "none", "none", "high", "no occasion marker"), ("Service of thanksgiving for the life of a ringer", "funeral", "person", "high", "Service of thanksgiving for the life"),
    ("Prior to the funeral of the old tenor", "funeral", "bells", "high", "Prior to the funeral"), ("The Mayor visits", "civic", "person", "high", "Mayor"), ("Harvest festival at the church", "seasonal", "building", "high", "Harvest festival"),
    ("Platinum Jubilee", "civic", "institution", "high", "Platinum Jubilee"), ("In memory of the old bells", "memorial", "bells", "high", "In memory"), ("for the NHS, with thanks to all staff", "compliment", "institution", "high", "with thanks to"),
    ("10 years since augmentation", "anniversary", "bells", "high", "years since"), ("The wedding at the cathedral", "wedding", "building", "high", "wedding"), ("In memory of the district", "memorial", "institution", "high", "In memory"),
], "footnote string", "occasion string, subject string, confidence string, evidence string")
def occasion_cases(df: DataFrame) -> DataFrame:
    """K-T2: all eleven occasions and five subjects, with what told them."""
    return df.withColumn("o", K.occasion(F.col("footnote"))).select("footnote", "o.*")


@told([
    ("St Mary", "Ely", "tower"), (None, "Ely", "tower"), ("", "Ringing Room", "virtual"), ("Any", "Handbell Stadium", "virtual"), ("NB Swift", "Ely", "vessel"), ("The Narrow Boat", "Ely", "vessel"), ("12 Example Street", "Ely", "address"), ("2a Example Road", "Ely", "address"),
    ("Rose Cottage", "Ely", "house"), ("The Old Vicarage", "Ely", "house"), ("Church Lane, St Mary", "Ely", "tower"), ("Abbey House", "Ely", "tower"), ("Swaledale", "Ely", "private ring"), ("Pig-le-Tower", "Ely", "private ring"), ("The Vicarage", "Ely", "house"), ("Parish Hall", "Ely", "private ring"),
], "building string, town string", "venue string")
def venue_cases(df: DataFrame) -> DataFrame:
    """K-T3: every reason not to look for a tower."""
    return df.withColumn("venue", K.venue(F.col("building"), F.col("town")))


#: A register of towers for the cases below: TowerID, RingID, Place, Place2, AltName, Dedicn, BareDedicn, County, Country, Region.
TOWERS = [
    (1, 1, "Ely", None, None, "Cath Ch of H Trinity", "Holy Trinity", "Cambridgeshire", "England", "East"), (2, 2, "York", "Clifton", None, "S Mary", "Mary", "North Yorkshire", "England", "North"), (3, 3, "York", None, "Minster", "S Peter", "Peter", "North Yorkshire", "England", "North"),
    (4, 4, "Sheffield", None, None, "S Peter & S Paul", None, "South Yorkshire", "England", "North"), (5, 5, "Dore", None, None, "Christ Ch", None, "South Yorkshire", "England", "North"), (6, 6, "Newton on Trent", None, None, "S Peter", None, "Lincolnshire", "England", "Midlands"),
    (7, 7, "Ely", None, None, "S Fagan", None, "South Glamorgan", "Wales", "South"), (2, 8, "York", "Clifton", None, "S Mary", "Mary", "North Yorkshire", "England", "North"),
    (10, 10, "Newport", None, None, "S Mary", None, "Powys", "Cymru", "Zone"), (11, 11, "Newport", None, None, "S John", None, "Fife", "Alba", "Zone"), (12, 12, "Newport", None, None, "S Paul", None, "Rhode Island", "America", "Zone"), (13, 13, "Newport", None, None, "S Luke", None, "Cork", "Eire", "Zone"),
    (14, 14, "Perth", None, None, "S George", None, "Western Australia", "WA", "Zone"), (15, 15, "Perth", None, None, "S Ninian", None, "Perth and Kinross", "Alba", "Zone"), (16, 16, "Nelson", None, None, "Christ Ch", None, "Marlborough", "NZ", "Zone"), (17, 17, "Nelson", None, None, "S John", None, "Lancashire", "England", "Zone"),
]
_DOVE = "TowerID long, RingID long, Place string, Place2 string, AltName string, Dedicn string, BareDedicn string, County string, Country string, Region string"


@told([
    (None, "Ely", "Cambs", 1, "high", "", "Unique tower, no building"), ("Holy Trinity", "Ely", "Cambridgeshire", 1, "high", "", "Unique tower"), ("The Deanery", "Ely", "Cambridgeshire", 1, "medium", "", "Only tower; dedication differs from source"),
    ("St Mary", "York", "Yorkshire", 2, "high", "3", "Dedication among several"), ("Clifton", "York", "Yorkshire", 2, "high", "3", "Dedication among several"), ("Christ Church, Dore", "Sheffield", None, 5, "high", "", "parish in building"),
    (None, "Sheffield, Dore", "Yorkshire", 5, "high", "", "parish in town"), ("St Peter", "Newton", "Lincs", 6, "high", "", "Fuzzy place match"), ("12 Example Street", "York", None, None, "none", "", "address"), (None, "Ringing Room", None, None, "none", "", "virtual"),
    (None, None, "Kent", None, "none", "", "no place given"), ("St Mary", "Nowhere", "Kent", None, "none", "", "no tower found"), ("Castle Keep", "York", "Yorkshire", None, "none", "2 3", "no tower of the town has the dedication"),
    (None, "Newport", "Wales", 10, "high", "", "Unique tower, no building"), (None, "Newport", "Scotland", 11, "high", "", "Unique tower, no building"), (None, "Newport", "USA", 12, "high", "", "Unique tower, no building"), (None, "Newport", "Ireland", 13, "high", "", "Unique tower, no building"),
    (None, "Perth", "Australia", 14, "high", "", "Unique tower, no building"), (None, "Perth", "Scotland", 15, "high", "", "Unique tower, no building"), (None, "Nelson", "New Zealand", 16, "high", "", "Unique tower, no building"), ("St John", "Nelson", "Lancs", 17, "high", "", "Unique tower"),
    ("St Paul", "Newport", None, 12, "high", "10 11 13", "Dedication among several"), ("St George", "Perth", "Canada", None, "none", "", "no tower found"),
], "building string, town string, county string", "dove_tower_id long, confidence string, others string, reasoning string")
def place_cases(df: DataFrame) -> DataFrame:
    """Places with buildings and counties, of all kinds of answers and of all groups of counties."""
    found = locate.locate(df, df.sparkSession.createDataFrame(TOWERS, _DOVE))
    keys = ["building", "town", "county"]
    met = df.alias("d").join(found.alias("f"), F.expr(" AND ".join(f"d.{c} <=> f.{c}" for c in keys)))
    return met.select("d.*", "f.dove_tower_id", "f.confidence", F.array_join("f.others", " ").alias("others"), "f.reasoning")


@told([
    ("St A", "T", "none", "", None, None, False), ("St A", "T", "high", "", 5, None, True), ("St Mary", "Gone", "high", "", 5, None, False), ("Both", "T", "medium", "Dual tower", 5, None, False),
    ("", "T", "medium", "differs from source", 5, "S Mary", True), ("The Farm", "T", "medium", "differs from source", 5, "S Mary", False), ("St Mary Magd", "T", "medium", "differs from source", 5, "S Mary Magdalene", True),
    ("St Paul", "T", "medium", "differs from source", 5, "S Mary", False), ("St J B", "Strensham", "medium", "differs from source", 5, "S John", True), ("Dunroamin", "T", "medium", "differs from source", 5, "S Mary", False),
    ("unknown", "T", "medium", "Partial dedication", 5, None, False), ("St A", "T", "medium", "Partial dedication", 5, None, True), ("Old School", "T", "medium", "Fuzzy place match", 5, None, False), ("St A", "T", "medium", "Fuzzy place match", 5, None, True),
    ("St A", "T", "medium", "?", 5, None, False),
], "building string, town string, confidence string, reasoning string, dove_tower_id long, dedication string", "accepted boolean")
def adjudication_cases(df: DataFrame) -> DataFrame:
    """Proposals that the ladder accepts and refuses."""
    return lexicon.adjudicate(df, [("St J B", "Strensham")], [("St Mary", "Gone")])


LIBRARY = [
    ("m1", "Cambridge", "Cambridge Surprise Major", 8, "Surprise", 0, 1), ("m2", "Yorkshire", "Yorkshire Surprise Major", 8, "Surprise", 0, 1), ("m3", "Cambridge", "Cambridge Bob Major", 8, "Bob", 1, 0),
    ("m4", "Plain", "Plain Bob Minor", 6, "Bob", 1, 0), ("m5", None, "Little Bob Minor", 6, None, 0, 0), ("m6", "Kent", "Kent Treble Bob Minor", 6, "Treble Bob", 0, 1),
    ("m7", "St Clement's", "St Clement's College Bob Minor", 6, "Bob", 1, 0), ("m8", "Twin", "Twin Minor", 6, "Bob", 1, 0), ("m9", "Twin", "Twin  Minor.", 6, "Delight", 0, 1),
]


@told([
    ("Plain Bob Minor", None, "exact_title", "high", "m4"), ("plain bob  minor.", None, "normalised_title", "medium", "m4"), ("TWIN minor", None, "ambiguous_title", None, "m8 m9"), ("99 Tolling", None, "not_a_method", None, None),
    ("Something Else", None, "no_title_match", None, None), ("", None, "no_title_match", None, None), ("Spliced Surprise Major (2m)", "Cambridge, Yorkshire", "spliced_details", "high", "m1 m2"), ("Major (2m)", "Cambridge; Yorkshire", "spliced_details", "low", "m1 m2"),
    ("Spliced (2m)", "Cambridge", "no_stage_word", None, None), ("Minor (3m)", "", "spliced_no_details", None, None), ("Minor (3m)", "Kent, Plain Bob", "spliced_count_mismatch", None, "kent plainbob"),
    ("Minor (2m)", "720 Little Bob, 720 St.Clements", "spliced_details", "high", "m5 m7"), ("Doubles (1p/2m)", "x", "no_stage_word", None, None),
], "method string, details string", "outcome string, confidence string, found string")
def link_cases(df: DataFrame) -> DataFrame:
    """Every way in which a text is linked and every reason why not, over a small library."""
    spark = df.sparkSession
    library = spark.createDataFrame(LIBRARY, "method_id string, name string, title string, stage int, classification string, cls_plain int, cls_treble_dodging int")
    each = df.groupBy("method", "details").agg(F.count("*").alias("n"), F.xxhash64("method", "details").alias("perf_id"))
    links, lost = resolve.link_methods(each, library)
    good = links.groupBy("perf_id").agg(F.min("match_kind").alias("outcome"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_list("method_id")).alias("found"))
    none = F.lit(None).cast("string")
    bad = lost.select("perf_id", F.col("reason").alias("outcome"), none.alias("confidence"), F.from_json("candidates", "array<string>").alias("found"))
    return each.join(good.union(bad), "perf_id").select("method", "details", "outcome", "confidence", F.array_join("found", " ").alias("found"), F.explode(F.sequence(F.lit(1).cast("long"), "n")))


#: Names that meet in bands: performances, name, association, tower, and the canonical name that each should get.
_BANDS = [
    (range(0, 6), ("Robert Smith", "Ann Lee"), "Guild", 7), (range(10, 16), ("Bob Smith", "Ann Lee"), "Guild", 7), (range(20, 26), ("Rev John A Brown", "Ann Lee"), "Guild", 7), (range(30, 36), ("John B Brown", "Ann Lee"), "Guild", 7),
    (range(40, 46), ("James Green", "Ann Lee"), "Guild", 7), (range(50, 56), ("Jane Green", "Ann Lee"), "Guild", 7), (range(60, 66), ("William White", "Sue Gray"), "North", 1), (range(70, 76), ("W White", "Sam Gold"), "South", 2),
    (range(80, 86), ("Kate Hill", "Ann Lee"), "Guild", 7), (range(90, 96), ("Katherine M Hill", "Ann Lee"), "Guild", 7), (range(100, 110), ("Bj?rn Falk", "Ann Lee"), "Guild", 7), (range(110, 113), ("Bjrn Falk", "Ann Lee"), "Guild", 7),
]
_CANONICAL = {
    "Robert Smith": "Robert Smith", "Bob Smith": "Robert Smith", "Ann Lee": "Ann Lee", "John A Brown": "John A Brown", "John B Brown": "John B Brown", "James Green": "James Green", "Jane Green": "Jane Green", "William White": "William White",
    "W White": "W White", "Sue Gray": "Sue Gray", "Sam Gold": "Sam Gold", "Kate Hill": "Katherine M Hill", "Katherine M Hill": "Katherine M Hill", "Björn Falk": "Björn Falk",
}
_NAMED = ", ".join(f"('{a}', '{b}')" for a, b in _CANONICAL.items())


@recorded(f"SELECT concat(a, n_nationkey) AS name, concat(b, n_nationkey) AS canonical FROM nation, (VALUES {_NAMED}) v(a, b)")
def people_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Short first names, middle initials, titles, misreadings and conflicts, a family of surnames for each nation."""
    rows = [(p, name, association, tower) for perfs, names, association, tower in _BANDS for p in perfs for name in names]
    bands = spark.createDataFrame(rows, "perf_id long, name string, association string, dove_tower_id long")
    nation = F.broadcast(table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("k")))  # a fixed table
    many = bands.join(nation).select((F.col("k") * 1000 + F.col("perf_id")).alias("perf_id"), F.concat("name", F.col("k").cast("string")).alias("name"), "association", (F.col("k") * 100 + F.col("dove_tower_id")).alias("dove_tower_id"))
    return resolve.resolve_names(many).select("name", "canonical")


_KIN = [
    ("m1", "Plain", 6, "Bob", "palindromic", 1, "1AB", "-16-16-16,12"), ("m2", "Plain", 8, "Bob", "palindromic", 1, "1AB 2CD", "-18-18-18-18,12"), ("m3", "Plain", 8, "Surprise", "palindromic", 1, "9ZZ", "-38-14-1258-36-14-58-16-78,12"),
    ("m4", "Plain", 10, "Bob", "palindromic", 3, None, "-10-10,12"), ("m5", None, 6, "Bob", None, 1, None, "-16,12"), ("m6", "Lone", 6, "Bob", None, 1, None, "-16,12"), ("m7", "Odd", 6, "Bob", "", 1, "x", "34.34.34"), ("m8", "Odd", 8, "Bob", "", 1, "y", "12.1.23.4.5.6.7.8.1.2"),
    ("m9", "Void", 6, None, None, None, None, None), ("m0", "Void", 8, None, None, None, None, "-18"),
]
_JUDGED = [
    ("m1", "m2", "extension", "high", 0.9167), ("m1", "m3", "name_only", "high", 0.5), ("m1", "m4", "name_only", "high", 0.875), ("m2", "m4", "name_only", "high", 0.875), ("m3", "m4", "name_only", "high", 0.5),
    ("m7", "m8", "name_only", "high", 0.0), ("m9", "m0", "name_only", "low", 0.0),
]


@recorded("SELECT concat(n_nationkey, p) AS parent, concat(n_nationkey, c) AS child, r AS relationship, f AS confidence, CAST(s AS DOUBLE) AS front_share FROM nation, (VALUES " + ", ".join(f"('{p}', '{c}', '{r}', '{f}', {s})" for p, c, r, f, s in _JUDGED) + ") v(p, c, r, f, s)")
def extension_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The verdicts on families of methods, a family of each for each nation."""
    kin = spark.createDataFrame(_KIN, "method_id string, name string, stage int, classification string, symmetry string, number_of_hunts int, extension_construction string, notation string")
    nation = F.broadcast(table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("k")))  # a fixed table
    many = kin.join(nation).withColumn("method_id", F.concat("k", "method_id")).withColumn("name", F.concat("name", "k")).drop("k")
    return lineage.extensions(many).select(F.col("parent_method_id").alias("parent"), F.col("child_method_id").alias("child"), "relationship", "confidence", F.round("front_share", 4).alias("front_share"))


_TERMS = [
    "Cath & Abbey Ch of S Alban", "Cath Ch of S Paul", "Cath", "Priory Ch of SS Mary & Blaise", "Collegiate Ch of S Mary", "Ch of the Holy Ghost", "H Trinity", "H Cross", "H Innocents", "All SS", "Christ Ch", "BVM", "Assumption of BVM", "Nativity of BVM", "S Mary V", "St Mary the V", "S Mary Magd",
    "S John Bapt", "St John B", "S John Div", "S John the Evang", "S Mark Ev", "St Luke Ev", "S Thomas a Becket", "St Thomas of Canterbury", "S Michael & AA", "St Edmund K & M", "Edmund K&M", "S Alphege B & M", "S Edward K&C", "S Clement P & M", "Parish Ch", "SS Peter & Paul", "Sts Cosmas & Damian",
    "SS Peter & Sts Paul", "S Mary and St Anne", "St. Giles", "S  Laurence", "Holy Laurence", "Katherine", "St Catharine", "Swithun", "S Bartholomew", "Botolph", "Ceadda", "Audrey", "S Petrock", "Our Lady", "Peter & Paul", "cath of norwich",
]
_PLACES = [
    "Barrow-on-Soar", "Newcastle on Tyne", "Stratford on Avon", "Kingston-upon-Thames", "Berwick on Tweed", "Stoke-on-Trent", "Stoke upon Trent", "South Mymms", "Bishop's Stortford", "King's Lynn", "king's lynn,", "Stoke-by-Nayland", "Weston super Mare", "Weston-super-Mare", "Stow on the Wold",
    "Chapel en le Frith", "St Albans", "St. Ives", "St Kirkby-in-Ashfield", "York", ", Ely ,", "Bury St Edmunds",
]


def _rules_sql(domain: str, rules: list[dict]) -> str:
    re2 = lambda x: literal(x.replace("$1", "\\1"))
    return ", ".join(f"('{domain}', {k}, {literal(r['pattern'])}, {re2(r['put'])}, '{r['kind']}', {str(r['last']).lower()}, {literal(r['unless'])})" for k, r in enumerate(rules, 1))


_FOUND = ", ".join(f"({k}, '{d}', {literal(t)})" for k, (d, t) in enumerate([*[("dedication", x) for x in _TERMS], *[("place_name", x) for x in _PLACES]]))
_N = len(_TERMS) + len(_PLACES)


@recorded(f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {_rules_sql('dedication', lexicon.dedication_rules())}, {_rules_sql('place_name', lexicon.place_rules())}) v(domain, k, pattern, put, kind, final, unless_)),
said AS (SELECT domain, trim(term) AS term, c_custkey AS seq, concat('c', c_custkey) AS example FROM customer JOIN (VALUES {_FOUND}) v(k, domain, term) ON c_custkey % {_N} = k),
pooled AS (SELECT domain, term, count(*) AS evidence_count, array_to_string(list(example ORDER BY seq)[1:2], '; ') AS source_examples FROM said GROUP BY ALL),
f AS (SELECT domain, term, 0 AS k, term AS text, 'verbatim' AS category FROM pooled
  UNION ALL
  SELECT f.domain, f.term, r.k, CASE WHEN hit THEN regexp_replace(f.text, r.pattern, r.put, 'g') ELSE f.text END, CASE WHEN NOT hit OR r.final AND f.category <> 'verbatim' THEN f.category ELSE r.kind END
  FROM f JOIN rules r ON r.domain = f.domain AND r.k = f.k + 1, LATERAL (SELECT regexp_matches(f.text, r.pattern) AND NOT regexp_matches(f.text, r.unless_) AS hit)),
done AS (SELECT domain, term, last(text ORDER BY k) AS text, last(category ORDER BY k) AS category FROM f GROUP BY ALL)
SELECT domain, term AS raw_term, trim(regexp_replace(text, '\\s+', ' ', 'g'), CASE domain WHEN 'place_name' THEN ', ' ELSE ' ' END) AS canonical_term, category, evidence_count, source_examples FROM done JOIN pooled USING (domain, term)""")
def lexicon_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Terms on which every kind of rule fires, with category, evidence and examples; the oracle applies the rules one after another."""
    cases = F.broadcast(spark.createDataFrame([(k, d, t) for k, (d, t) in enumerate([*[("dedication", x) for x in _TERMS], *[("place_name", x) for x in _PLACES]])], "k long, domain string, term string"))  # a fixed list
    said = table(spark, folder, "customer").select(F.col("c_custkey").alias("seq"), (F.col("c_custkey") % _N).alias("k")).join(cases, "k").withColumn("example", F.concat(F.lit("c"), F.col("seq").cast("string")))
    return lexicon.lexicon(said).where("domain <> 'saint_name'").select("domain", "raw_term", "canonical_term", "category", "evidence_count", "source_examples")


@recorded("SELECT a AS raw_term, b AS canonical_term, 'spelling_variant' AS category FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in lexicon.SPELLINGS.items()) + ") v(a, b)")
def saint_names(spark: SparkSession, folder: str) -> DataFrame:
    """The cross references of saints' names."""
    none = spark.createDataFrame([], "term string, domain string, example string, seq long")
    return lexicon.lexicon(none).select("raw_term", "canonical_term", "category")


@recorded("WITH d AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'x p p b y' WHEN 1 THEN 'p, p, b' WHEN 2 THEN 'ppb' WHEN 3 THEN NULL ELSE '100% p_b' END AS details FROM orders) SELECT c AS calls, count(*) FILTER (WHERE contains(details, a) OR contains(details, b)) AS known, count(*) FILTER (WHERE contains(details, a) OR contains(details, b)) = 0 AS novel FROM d, (VALUES ('ppb', 'p p b', 'p, p, b'), ('pbp', 'p b p', 'p, b, p')) v(c, a, b) GROUP BY c")
def novelty_cases(spark: SparkSession, folder: str) -> DataFrame:
    """K-T4: a calling that stands in details in either spelling, and one that doesn't."""
    k = F.col("o_orderkey") % 5
    details = table(spark, folder, "orders").select(F.when(k == 0, "x p p b y").when(k == 1, "p, p, b").when(k == 2, "ppb").when(k == 4, "100% p_b").alias("details"))
    one = lambda calls: K.novelty(details, calls).select(F.lit(calls).alias("calls"), "known", "novel")
    return one("ppb").union(one("pbp"))


@told([(c, p) for c, p in [("1", 0), ("2", 1), ("9", 8), ("0", 9), ("E", 10), ("e", 10), ("T", 11), ("A", 12), ("d", 15), ("X", None), ("", None), ("12", None)]], "symbol string", "place int")
def symbol_places(df: DataFrame) -> DataFrame:
    """K1."""
    return df.withColumn("place", kernel.place_of(F.col("symbol")).cast("int"))


@told([
    ("-16-16-16", "- 16 - 16 - 16"), ("3.1.E.3", "3 1 E 3"), ("x 16 X", "x 16 X"), ("34-34.16", "34 - 34 16"), ("", ""), ("5T-14.5T", "5T - 14 5T"),
], "notation string", "changes string")
def notation_changes(df: DataFrame) -> DataFrame:
    """K2."""
    return df.withColumn("changes", F.array_join(kernel.split_changes(F.col("notation")), " "))


@told([
    ("123456", "-", "214365"), ("123456", "x", "214365"), ("123456", "16", "132546"), ("214365", "12", "213456"), ("123456", "1234", "123465"), ("12345", "3", "21354"), ("12345", "1", "13254"), ("1234567", "-", "2143657"),
    ("12345678", "1258", "12435768"), ("12345678", "38", "21354768"), ("1234567890ET", "1T", "132547698E0T"),
], "row string, change string", "next string")
def change_steps(df: DataFrame) -> DataFrame:
    """K3: places that stay and neighbours that swap, with a bell left over."""
    return df.withColumn("next", F.array_join(kernel.apply_change(F.split("row", ""), F.col("change")), ""))


@told([("-16-16-16", "12", "135264", 12), ("-16-16-16", "14", "123564", 12), ("-16-16-16", "1234", "132564", 12), ("-16-16-16,16", "14", "123564", 12)], "body string, call string", "head string, rows int")
def called_leads(df: DataFrame) -> DataFrame:
    """K7: a plain lead, a bob and a single of Plain Bob Minor."""
    rows = kernel.called_lead(F.col("body"), F.col("call"), F.lit(6))
    return df.withColumn("head", F.array_join(F.element_at(rows, -1), "")).withColumn("rows", F.size(rows))


@recorded("SELECT o_orderkey % 10 AS composition, count(*) = count(DISTINCT CASE WHEN o_orderkey % 10 IN (3, 7) THEN o_custkey ELSE o_orderkey END) AS true FROM orders GROUP BY 1")
def block_truth(spark: SparkSession, folder: str) -> DataFrame:
    """K8: compositions of which two ring rows twice."""
    k = F.col("o_orderkey") % 10
    blocks = table(spark, folder, "orders").select(k.alias("composition"), F.when(k.isin(3, 7), F.col("o_custkey")).otherwise(F.col("o_orderkey")).cast("string").alias("row"))
    return kernel.truth(blocks)


def _heads_sql(stage: int) -> str:
    """The course heads of a stage, grown a bell at a time."""
    bells = ", ".join(f"('{b}')" for b in kernel.ORDER[:stage])
    return f"h AS (SELECT '1' AS head UNION ALL SELECT concat(head, b) FROM h, (VALUES {bells}) v(b) WHERE length(head) < {stage} AND strpos(head, b) = 0), heads AS (SELECT head FROM h WHERE length(head) = {stage})"


def _moved_sql(head: str, end: str, stage: int) -> str:
    return f"array_to_string(list_transform(string_split({end}, ''), lambda b: substr({head}, strpos('{kernel.ORDER[:stage]}', b), 1)), '')"


@recorded(f"WITH RECURSIVE {_heads_sql(6)} SELECT head, call, {_moved_sql('head', 'e', 6)} AS next_head FROM heads, (VALUES ('p', '135264'), ('b', '123564'), ('s', '132564')) v(call, e)")
def course_heads_minor(spark: SparkSession, folder: str) -> DataFrame:
    """K9: where each call of Plain Bob Minor leads from each of the 120 heads."""
    return kernel.transitions(kernel.course_heads(spark, 6), "-16-16-16", CALLS, 6)


#: Which place each bell of a row of eight comes from, by change.
_MOVES = {
    "-": [2, 1, 4, 3, 6, 5, 8, 7], "38": [2, 1, 3, 5, 4, 7, 6, 8], "14": [1, 3, 2, 4, 6, 5, 8, 7], "1258": [1, 2, 4, 3, 5, 7, 6, 8], "36": [2, 1, 3, 5, 4, 6, 8, 7], "58": [2, 1, 4, 3, 5, 7, 6, 8], "16": [1, 3, 2, 5, 4, 6, 8, 7],
    "78": [2, 1, 4, 3, 6, 5, 7, 8], "12": [1, 2, 4, 3, 6, 5, 8, 7],
}
_HALF = ["-", "38", "-", "14", "-", "1258", "-", "36", "-", "14", "-", "58", "-", "16", "-", "78"]
_LEAD = ", ".join(f"({k}, {_MOVES[c]})" for k, c in enumerate([*_HALF, *_HALF[-2::-1], "12"], 1))
_ROWS = f"""{_heads_sql(8)}, steps AS (SELECT * FROM (VALUES {_LEAD}) v(k, move)),
lead AS (SELECT 0 AS k, '12345678' AS row UNION ALL SELECT steps.k, array_to_string(list_transform(move, lambda i: substr(row, CAST(i AS INT), 1)), '') FROM lead JOIN steps ON steps.k = lead.k + 1),
rows AS (SELECT head, k, {_moved_sql('head', 'row', 8)} AS row FROM heads, lead WHERE k > 0)"""


@recorded(f"WITH RECURSIVE {_ROWS} SELECT DISTINCT a.head, b.head AS false_head FROM rows a JOIN rows b ON a.row = b.row AND a.head <> b.head")
def false_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Course heads of Cambridge Surprise Major whose plain leads share a row."""
    return kernel.false_heads(kernel.head_rows(kernel.course_heads(spark, 8), MAJOR, CALLS["p"], 8))


@recorded(f"""WITH RECURSIVE {_ROWS} SELECT head, sum(CASE WHEN contains(row, '5678') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN starts_with(row, '1234') THEN 2 ELSE 0 END + CASE WHEN row = '15263748' THEN 5 ELSE 0 END
  + CASE WHEN ends_with(row, '8765') THEN 2 WHEN ends_with(row, '5678') THEN 1.5 ELSE 0 END) AS score FROM rows GROUP BY head""")
def head_music(spark: SparkSession, folder: str) -> DataFrame:
    """The music of each head's plain lead, too short for its tenors to be parted long."""
    return kernel.musicality(kernel.head_rows(kernel.course_heads(spark, 8), MAJOR, CALLS["p"], 8), 8)
