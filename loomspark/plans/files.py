"""Sources and sinks by round trip: the driver's tables go out as files and come back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.materialize import scratch
from loomspark.operators import upkeep as U
from loomspark.operators.views import composition_methods_view
from loomspark.plans.registry import recorded
from loomspark.schemas import load_csv
from loomspark.sources import fetch, readers, sinks, sql_files
from loomspark.sources.tables import table
from loomspark.streaming import increments as I

_CELLS = """SELECT o_orderkey AS `Order Key`, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'A, "b" c' WHEN 3 THEN NULL WHEN 4 THEN 'line one\nline two' ELSE o_orderpriority END AS `Place-Name`,
  CASE WHEN o_orderkey % 4 = 0 THEN 'x7' ELSE CAST(o_custkey AS STRING) END AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'nan' ELSE CAST(o_totalprice AS STRING) END AS Price FROM {orders}"""


@recorded("""SELECT o_orderkey AS Order_Key, CASE o_orderkey % 6 WHEN 2 THEN 'A, "b" c' WHEN 4 THEN concat('line one', chr(10), 'line two') WHEN 5 THEN o_orderpriority END AS Place_Name,
  CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS n, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS Price, CAST(NULL AS VARCHAR) AS missing FROM orders""")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Headers made safe, empty and nan cells null, numbers that are none null, quotes, commas and line ends inside cells."""
    path = scratch(spark, "csv")
    cells = spark.sql(_CELLS, orders=table(spark, folder, "orders"))
    sinks.write_csv(cells, path, ["Order Key", "Place-Name", "n", "Price"])
    return readers.scan_csv(spark, path, {"Order_Key": "long", "Place_Name": "string", "n": "long", "Price": "double", "missing": "string"})


@recorded("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def csv_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """A file or more for each year, read by one wildcard, and the latest row of each key."""
    path = scratch(spark, "years")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    orders.write.partitionBy("year").option("header", True).csv(path)
    found = readers.scan_csv(spark, f"{path}/year=*/*.csv", {"o_custkey": "long", "o_orderkey": "long", "o_totalprice": "double"})
    return readers.latest_of(found, "o_custkey", "o_orderkey")


@recorded("SELECT o_orderkey AS perf_id, 1 AS position, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS footnote FROM orders")
def csv_by_schema(spark: SparkSession, folder: str) -> DataFrame:
    """A table of the corpus by its stated schema."""
    path = scratch(spark, "footnotes")
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("perf_id"), F.lit(1).alias("position"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("footnote"))
    sinks.write_csv(rows, path, ["perf_id", "position", "footnote"])
    return load_csv(spark, "performance_footnotes", path)


def _documents(rows: DataFrame, path: str, root: str, files: int = 16) -> str:
    """XML files of one root each around the rows (value), which are dealt out by hash."""
    spark = rows.sparkSession
    dealt = rows.select("value", F.pmod(F.xxhash64("value"), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("place"))
    ends = spark.range(files).select(F.col("id").cast("int").alias("file"), F.explode(F.array(F.struct(F.lit(f"<{root}>").alias("value"), F.lit(0).alias("place")), F.struct(F.lit(f"</{root}>").alias("value"), F.lit(2).alias("place")))).alias("e"))
    every = dealt.union(ends.select("e.value", "file", "e.place")).repartition("file").sortWithinPartitions("file", "place")
    every.select("value", "file").write.partitionBy("file").text(path)
    return path


def _methods_file(spark: SparkSession, folder: str) -> str:
    """One method set for each part, with its first performances."""
    path, k = scratch(spark, "methods"), F.col("p_partkey")
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    method = say(
        "<method id=\"m", k, "\"><title>", F.col("p_name"), " ", F.col("p_size"), "</title><name> ", F.when(k % 4 > 0, F.col("p_name")).otherwise(""), " </name><notation>-1", F.col("p_size"), "</notation><falseness><fchGroups>B</fchGroups></falseness><performances>",
        "<firstTowerbellPeal><date>1999-01-0", k % 9 + 1, "</date><location><town> Town ", k % 7, " </town><building/></location></firstTowerbellPeal>",
        F.when(k % 2 == 0, "<firstHandbellPeal><date>2000-01-01</date></firstHandbellPeal>").otherwise(""), "</performances></method>",
    )
    text = say("<methodSet><properties><stage>", F.when(k % 5 > 0, F.col("p_size").cast("string")).otherwise("x"), "</stage><classification plain=\"", (k % 3 == 0), "\">", F.col("p_type"), "</classification></properties>", method, "</methodSet>")
    return _documents(table(spark, folder, "part").select(text.alias("value")), path, "collection")


@recorded("""SELECT concat('m', p_partkey) AS method_id, concat(p_name, ' ', p_size) AS title, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 5 > 0 THEN p_size END AS stage, p_type AS classification,
  CAST(p_partkey % 3 = 0 AS INT) AS cls_plain, concat('-1', p_size) AS notation, 'B' AS fch_groups FROM part""")
def xml_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Methods of a library of method sets."""
    return readers.scan_methods(spark, _methods_file(spark, folder))[0].select("method_id", "title", "name", "stage", "classification", "cls_plain", "notation", "fch_groups")


@recorded("""SELECT concat('m', p_partkey) AS method_id, 0 AS position, 'firstTowerbellPeal' AS event_type, concat('1999-01-0', p_partkey % 9 + 1) AS perf_date, concat('Town ', p_partkey % 7) AS town, CAST(NULL AS VARCHAR) AS building FROM part
UNION ALL SELECT concat('m', p_partkey), 1, 'firstHandbellPeal', '2000-01-01', NULL, NULL FROM part WHERE p_partkey % 2 = 0""")
def xml_first_events(spark: SparkSession, folder: str) -> DataFrame:
    """The first performances of methods, in the order of their kinds."""
    return readers.scan_methods(spark, _methods_file(spark, folder))[1].select("method_id", "position", "event_type", "perf_date", "town", "building")


def _performances_file(spark: SparkSession, folder: str) -> str:
    path, k = scratch(spark, "performances"), F.col("o_orderkey")
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    text = say(
        "<performance id=\"", F.when(k % 50 == 49, "Px").otherwise("P"), k, F.when(k % 50 == 49, "y").otherwise(""), "\"><association> ", F.col("o_orderpriority"), " </association><place dove-tower-id=\"", F.when(k % 6 > 0, F.col("o_custkey").cast("string")).otherwise("x"),
        "\"><place-name type=\"place\">Place ", k % 8, "</place-name><place-name type=\"county\">Kent</place-name><ring type=\"tower\" tenor=\"12-2-13\"/></place><title><changes>50", k % 90 + 10, "</changes> <method>Plain Bob</method></title><date>2020-01-02</date>",
        "<ringers><ringer bell=\"1\">A ", k % 5, "</ringer><ringer bell=\"2\" conductor=\"true\">C D</ringer></ringers><footnote>First</footnote><footnote> </footnote><flag type=\"first\" bell=\"1\">A</flag></performance>",
    )
    return _documents(table(spark, folder, "orders").select(text.alias("value")), path, "performances")


@recorded("""SELECT o_orderkey AS perf_id, concat('P', o_orderkey) AS bb_id, trim(o_orderpriority) AS association, concat('Place ', o_orderkey % 8) AS place, 'Kent' AS county, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey END AS dove_tower_id, '12-2-13' AS tenor,
  CAST(concat('50', o_orderkey % 90 + 10) AS INT) AS changes, 'Plain Bob' AS method FROM orders WHERE o_orderkey % 50 <> 49""")
def xml_performances(spark: SparkSession, folder: str) -> DataFrame:
    """Performance records; those without a numeric id are left out."""
    return readers.scan_performances(spark, _performances_file(spark, folder))["performances"].select("perf_id", "bb_id", "association", "place", "county", "dove_tower_id", "tenor", "changes", "method")


@recorded("""WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 50 <> 49)
SELECT 'ringers' AS part, k AS perf_id, 0 AS position, concat('A ', k % 5) AS said FROM o UNION ALL SELECT 'ringers', k, 1, 'C D' FROM o
UNION ALL SELECT 'footnotes', k, 0, 'First' FROM o UNION ALL SELECT 'footnotes', k, 1, NULL FROM o UNION ALL SELECT 'flags', k, 0, 'A' FROM o""")
def xml_performance_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Ringers, footnotes and flags by their places."""
    found = readers.scan_performances(spark, _performances_file(spark, folder))
    one = lambda part, said: found[part].select(F.lit(part).alias("part"), "perf_id", "position", F.col(said).alias("said"))
    return one("ringers", "name").union(one("footnotes", "footnote")).union(one("flags", "flag_text"))


def _compositions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    path, k = scratch(spark, "compositions"), F.col("s_suppkey")
    part = lambda n: F.struct(F.concat(F.lit("Method "), (k + n).cast("string")).alias("title"), F.lit("").alias("name"), F.lit("8").alias("rowStage"), ((k + n) % 150).cast("string").alias("mnemonic"))
    row = F.struct(
        F.when(k % 20 > 0, k.cast("string")).otherwise("none").alias("id"), F.col("s_name").alias("title"), F.lit("").alias("opus"), F.lit("8").alias("stage"), F.when(k % 3 > 0, (5000 + k).cast("string")).alias("length"), (k % 2 == 0).alias("backstrokeStart"),
        F.array(F.lit("1"), F.lit("2")).alias("partheads"), F.array(part(0), part(1)).alias("methodDefinitions"),
    )
    table(spark, folder, "supplier").select(F.to_json(row).alias("value")).write.text(path)
    return readers.scan_compositions(spark, path)


@recorded("SELECT CASE WHEN s_suppkey % 20 > 0 THEN s_suppkey END AS composition_id, s_name AS title, CAST(NULL AS VARCHAR) AS opus, 8 AS stage, CASE WHEN s_suppkey % 3 > 0 THEN CAST(5000 + s_suppkey AS INT) END AS length, CAST(s_suppkey % 2 = 0 AS INT) AS backstroke_start, '1|2' AS partheads FROM supplier")
def json_compositions(spark: SparkSession, folder: str) -> DataFrame:
    """Compositions, one JSON object a line."""
    return _compositions(spark, folder)[0].select("composition_id", "title", "opus", "stage", "length", "backstroke_start", "partheads")


@recorded("""WITH p AS (SELECT s_suppkey AS c, n AS position, concat('Method ', s_suppkey + n) AS method_title, (s_suppkey + n) % 150 AS m FROM supplier, (VALUES (0), (1)) v(n) WHERE s_suppkey % 20 > 0)
SELECT s_name AS title, c AS composition_id, position, method_title, CASE WHEN p_partkey IS NOT NULL THEN concat('m', m) END AS method_id, p_name AS library_title FROM p JOIN supplier ON s_suppkey = c LEFT JOIN part ON p_partkey = m AND p_partkey % 4 > 0""")
def view_composition_methods(spark: SparkSession, folder: str) -> DataFrame:
    """The methods of each composition in their order, with the library's title where its number is known there."""
    compositions, parts = _compositions(spark, folder)
    library = table(spark, folder, "part").where("p_partkey % 4 > 0").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("method_id"), F.col("p_name").alias("title"))
    known = readers.known_method_ids(parts.withColumnRenamed("mnemonic", "library_method_id"), library)
    return composition_methods_view(compositions.select("composition_id", "title"), known.select("composition_id", "position", "method_title", "method_id"), library).select("title", "composition_id", "position", "method_title", "method_id", "library_title")


@recorded("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders
UNION ALL SELECT -1 - o_orderkey, o_totalprice, 'new' FROM orders WHERE o_orderkey % 100 = 0""")
def table_by_parts(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot in folders by status, one of which is written again, and an increment."""
    path, orders = scratch(spark, "table"), table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.write_table(orders, path, ["o_orderstatus"])
    sinks.write_table(orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1), path, ["o_orderstatus"])
    sinks.write_table(orders.where("o_orderkey % 100 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", F.lit("new").alias("o_orderstatus")), path, ["o_orderstatus"], append=True)
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@recorded("SELECT 'regions' AS section, CAST(json_object('r_regionkey', r_regionkey, 'r_name', r_name) AS VARCHAR) AS payload FROM region UNION ALL SELECT 'nations', CAST(json_object('n_nationkey', n_nationkey, 'n_name', n_name) AS VARCHAR) FROM nation")
def page_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of a page as JSON."""
    regions = sinks.payload(table(spark, folder, "region").select("r_regionkey", "r_name"), "regions")
    return regions.union(sinks.payload(table(spark, folder, "nation").select("n_nationkey", "n_name"), "nations"))


@recorded("SELECT o_orderstatus AS status, count(*) AS n, '; -- data' AS note FROM orders WHERE o_custkey >= 20 GROUP BY o_orderstatus")
def sql_file(spark: SparkSession, folder: str) -> DataFrame:
    """The second statement of a file of SQL, its parameter bound; comments and dividers inside strings are data."""
    text = f"""-- one; not a statement
SELECT 'it''s; not this' AS x; -- the next; one
SELECT o_orderstatus AS status, count(*) AS n, '; -- data' AS note FROM parquet.`{folder}/orders.parquet` WHERE o_custkey >= :least GROUP BY o_orderstatus;
"""
    path = scratch(spark, "statements")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    found = spark.read.format("binaryFile").load(path).where("length > 0").first()  # one file of statements
    return sql_files.run(spark, found["content"].decode(), 1, least=20)


@recorded("SELECT t AS table, state FROM (VALUES ('gone_table', 'FAIL'), ('perhaps_table', 'SKIP')) v(t, state)")
def missing_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Declared tables that the catalog lacks; those that are there are not named."""
    for name in ("region", "nation"):
        table(spark, folder, name).createOrReplaceTempView(f"here_{name}")
    found = U.missing_tables(spark, ["here_region", "gone_table", "here_nation", "perhaps_table"], ("perhaps_table",))
    return spark.createDataFrame(found, "table string, state string")


@recorded("SELECT q AS query, faulty FROM (VALUES ('by key', false), ('by range alone', true), ('by key and range', false)) v(q, faulty)")
def plan_check(spark: SparkSession, folder: str) -> DataFrame:
    """Which of three joins would compare every row with every other."""
    a, b = table(spark, folder, "nation"), table(spark, folder, "supplier")
    key, span = F.col("n_nationkey") == F.col("s_nationkey"), F.col("n_nationkey") < F.col("s_suppkey")
    plans = {"by key": a.join(b, key), "by range alone": a.join(b, span), "by key and range": a.join(b, key & span)}
    return spark.createDataFrame([(name, bool(U.plan_faults(df))) for name, df in plans.items()], "query string, faulty boolean")


def _landing(spark: SparkSession, folder: str, columns: list[str], files: int = 3) -> tuple[str, DataFrame]:
    """Events as files that have landed, in order of time."""
    path, events = scratch(spark, "landing"), table(spark, folder, "events").select(*columns)
    for k in range(files):
        events.where(F.col("event_id") % files == k).coalesce(1).write.mode("append").parquet(path)
    return path, events


@recorded("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_by_increments(spark: SparkSession, folder: str) -> DataFrame:
    """Three landed files, a batch each, upserted into a store by buckets."""
    path, events = _landing(spark, folder, ["user_id", "event_id", "event_type", "ts"])
    store = scratch(spark, "store")
    I.keep_latest(I.landed(spark, path, events.schema, 1), f"{store}/rows", f"{store}/log", ["user_id"], [F.col("ts"), F.col("event_id")]).awaitTermination()
    return I.latest_rows(spark, f"{store}/rows", events.schema)


@recorded("SELECT event_id, user_id FROM events")
def gated_load(spark: SparkSession, folder: str) -> DataFrame:
    """T5: batches that are complete are appended; here all are, in the tests one is not."""
    path, events = _landing(spark, folder, ["event_id", "user_id"])
    store = scratch(spark, "gated")
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{store}/rows/batch={number}")
    I.gated(I.landed(spark, path, events.schema, 1), f"{store}/log", lambda b: b.where("event_id IS NULL").isEmpty(), put).awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{store}/rows").select(*events.columns)


@recorded("""WITH w AS (SELECT unnest([DATE '2024-01-01', DATE '2024-01-08', DATE '2024-01-15', DATE '2024-01-22', DATE '2024-01-29', DATE '2024-02-05']) AS begins),
e AS (SELECT DATE '2024-01-01' + CAST(7 * floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INT) AS begins, count(*) AS n FROM events GROUP BY 1)
SELECT 2 AS version, begins, CAST(least(begins + 6, DATE '2024-02-10') AS DATE) AS ends, CASE WHEN begins = DATE '2024-02-05' THEN 'pending' WHEN begins = DATE '2024-01-15' THEN 'failed' ELSE 'completed' END AS status FROM w LEFT JOIN e USING (begins)""")
def load_state(spark: SparkSession, folder: str) -> DataFrame:
    """T4: the state of weekly windows after two gates; what the first completed stays so, a state of an older version is dropped."""
    events = table(spark, folder, "events").select("event_id", "ts")
    spans = U.windows("2024-01-01", "2024-02-10", 7, spark)
    week = F.expr("date_add(DATE'2024-01-01', CAST(floor(datediff(ts, DATE'2024-01-01') / 7) * 7 AS INT))")
    truth = events.groupBy(week.alias("begins")).agg(F.count_distinct("event_id").alias("expected"))
    short = truth.withColumn("expected", F.col("expected") + (F.col("begins") == F.lit("2024-01-15").cast("date")).cast("int"))
    short = short.union(spark.sql("SELECT DATE'2024-02-05', 1L"))  # stated, but nothing of it has come
    stale = U.windows("2024-01-01", "2024-02-10", 7, spark).select(F.lit(1).alias("version"), "begins", "ends", F.lit("completed").alias("status"))
    first = U.window_state(U.window_gate(events, "ts", "event_id", short, spans), stale)
    late = short.withColumn("expected", F.col("expected") + 1)  # the source states more now; what was complete is not asked for again
    return U.window_state(U.window_gate(events, "ts", "event_id", late, spans), first)


@recorded("SELECT n_nationkey, n_name, 25 AS stated FROM nation")
def fetched_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a source that fails at first, once comes short, and is asked through a cache on the driver."""
    rows = [[r["n_nationkey"], r["n_name"]] for r in table(spark, folder, "nation").orderBy("n_nationkey").collect()]  # a fixed table stands for the network
    calls: dict[int, int] = {}

    def page(number: int) -> list:
        calls[number] = calls.get(number, 0) + 1
        if calls[number] == 1 and number % 2:
            raise OSError("the source is busy")
        whole = rows[10 * (number - 1) : 10 * number]
        return whole[:4] if number == 2 and calls[number] == 1 else whole

    asked = []

    def stated() -> int:
        asked.append(1)
        return fetch.expected_count(f"Found {len(rows)} performances")

    ask = lambda number: fetch.with_retries(lambda: page(number), sleep=lambda s: None)
    found = [x for p in fetch.pages(ask, 10, sleep=lambda s: None) for x in p]
    cache = scratch(spark, "cache")
    counts = [fetch.shared_cached(spark, cache, "stated count", stated, sleep=lambda s: None) for _ in range(2)]
    assert counts[0] == counts[1] and len(asked) == 1
    return spark.createDataFrame([(k, name, counts[0]) for k, name in found], "n_nationkey long, n_name string, stated int")
