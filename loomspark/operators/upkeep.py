"""Integrity checks, upserts and gated increments over any keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def band_check(df: DataFrame, name: str, low: int, high: int) -> DataFrame:
    """A table's rows against a band: PASS inside, FAIL if empty, else INFO."""
    counted = df.agg(F.count("*").alias("rows"))
    state = F.when(F.col("rows") == 0, "FAIL").when(F.col("rows").between(low, high), "PASS").otherwise("INFO")
    return counted.select(F.lit(name).alias("check"), "rows", state.alias("state"))


def missing_tables(spark: SparkSession, declared: list[str], optional: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Each declared table that the catalog lacks, FAIL or SKIP if optional."""
    here = {t.name for t in spark.catalog.listTables()}
    return [(t, "SKIP" if t in optional else "FAIL") for t in declared if t.lower() not in here]


def agreement(ours: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """C4: keys on one side only, in both directions; null-safe."""
    a, b = ours.select(F.col(key).alias("k")).distinct(), source.select(F.col(key).alias("k")).distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), a["k"].eqNullSafe(b["k"]), "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_ours"), F.count_if(F.col("a").isNull()).alias("only_source"))


def fan_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and the most rows of a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.max("n").alias("most"))


def orphans(child: DataFrame, key: str, *parents: tuple[DataFrame, str]) -> DataFrame:
    """Child rows whose key, if any, is in none of the parents."""
    left = child.where(F.col(key).isNotNull())
    for parent, own in parents:
        left = left.join(parent.select(F.col(own).alias("parent_key")), F.col(key) == F.col("parent_key"), "left_anti")
    return left


def join_identity(child: DataFrame, key: str, parent: DataFrame, own: str) -> DataFrame:
    """Linked, orphaned and joined rows, and whether joined = linked - orphaned, so that the join does not fan out."""
    p = parent.select(F.col(own).alias("parent_key"))
    joined = child.join(p, F.col(key) == F.col("parent_key")).agg(F.count("*").alias("joined"))
    counts = child.agg(F.count(key).alias("linked")).join(orphans(child, key, (parent, own)).agg(F.count("*").alias("orphaned"))).join(joined)
    return counts.withColumn("holds", F.col("joined") == F.col("linked") - F.col("orphaned"))


def literal_nans(df: DataFrame) -> DataFrame:
    """Rows that say 'nan' in each text column, in one pass."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    counts = df.agg(*[F.count_if(F.lower(F.trim(F.col(c))) == "nan").alias(c) for c in texts])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in texts]))
    return counts.select(rows.alias("r")).select("r.*")


def plan_faults(df: DataFrame) -> list[str]:
    """The joins of a plan that compare every row with every other."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("CartesianProduct", "BroadcastNestedLoopJoin") if x in plan]


def coverage(whole: DataFrame, linked: DataFrame, unresolved: DataFrame, key: str) -> DataFrame:
    """Every key is linked or unresolved, and none both."""
    a, b = linked.select(key).distinct().withColumn("l", F.lit(1)), unresolved.select(key).distinct().withColumn("u", F.lit(1))
    both = whole.select(key).distinct().join(a, key, "left").join(b, key, "left")
    l, u = F.col("l").isNotNull(), F.col("u").isNotNull()  # noqa: E741
    return both.agg(F.count("*").alias("keys"), F.count_if(l).alias("linked"), F.count_if(u).alias("unresolved"), F.count_if(l & u).alias("both"), F.count_if(~l & ~u).alias("neither"))


def identifiable(df: DataFrame, group: str, total: str, slack: int = 2) -> DataFrame:
    """C11: rows that a group and a total, known to within `slack`, single out.

    A row meets the totals around its own by equality on the shifted total, so a common group costs no more than its totals.
    """
    counts = df.groupBy(group, total).agg(F.count("*").alias("members_there"))
    near = counts.select(group, "members_there", F.explode(F.sequence(F.col(total) - slack, F.col(total) + slack)).alias(total))
    crowd = near.groupBy(group, total).agg(F.sum("members_there").alias("crowd")).where("crowd = 1")
    return df.join(crowd.select(group, total), [group, total])


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key; of rows alike in `order` the new one stays. Aggregated, so a key's old versions don't meet in a window."""
    columns = old.columns
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.select(*columns).withColumn("is_new", F.lit(1)))
    rest = [c for c in columns if c not in key]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order, F.col("is_new"))).alias("r"))
    return best.select(*[c if c in key else F.col(f"r.{c}").alias(c) for c in columns])


def replace_children(old: DataFrame, new: DataFrame, parent: str, touched: DataFrame) -> DataFrame:
    """Children of touched parents give way to the new ones, others stay."""
    return old.join(touched.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def staged_update(target: DataFrame, source: DataFrame, on: list[str], value: str) -> DataFrame:
    """`value` from the source row that is equal in `on`, nulls being equal; null where there is none."""
    s = source.select(*[F.col(c).alias(f"key_{c}") for c in on], F.col(value).alias("new_value"))
    match = F.lit(True)
    for c in on:
        match = match & target[c].eqNullSafe(F.col(f"key_{c}"))
    kept = [target[c] for c in target.columns if c != value]
    return target.join(s, match, "left").select(*kept, F.col("new_value").alias(value))


def windows(first: str, last: str, days: int, spark: SparkSession) -> DataFrame:
    """T4: consecutive date windows of `days` days, both ends included, the last one clipped."""
    steps = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL {int(days)} DAY)) AS begins")
    return steps.select("begins", F.least(F.date_add("begins", days - 1), F.lit(last).cast("date")).alias("ends"))


def window_gate(rows: DataFrame, date: str, key: str, expected: DataFrame, spans: DataFrame) -> DataFrame:
    """T5: found distinct keys and rows of each window against those expected; complete only if all agree.

    `expected`: begins, expected. Rows meet their window by the day, so windows must not overlap.
    """
    days = spans.select("begins", F.explode(F.sequence("begins", "ends")).alias("day"))
    found = rows.select(F.col(date).cast("date").alias("day"), F.col(key).alias("k")).join(F.broadcast(days), "day").groupBy("begins").agg(F.count_distinct("k").alias("found"), F.count("*").alias("rows"))  # one row a day of the span
    out = spans.join(expected, "begins", "left").join(found, "begins", "left").select("begins", "ends", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("rows", F.lit(0)).alias("rows"))
    return out.withColumn("complete", (F.col("found") == F.col("expected")) & (F.col("rows") == F.col("found")))


STATE_VERSION = 2
_STATE = "version int, begins date, ends date, status string"


def window_state(gate: DataFrame, old: DataFrame | None = None, version: int = STATE_VERSION) -> DataFrame:
    """T4: version, begins, ends and status of each window: completed, failed or pending.

    `gate`: as from `window_gate`. A window that `old` has completed stays so; a state of another version is
    dropped whole, as it may call short windows complete. A window of which nothing was found is pending.
    """
    spark = gate.sparkSession
    known = (spark.createDataFrame([], _STATE) if old is None else old).where(F.col("version") == version)
    done = known.where("status = 'completed'").select("begins", "ends", F.lit(True).alias("done"))
    status = F.when(F.col("done") | F.col("complete"), "completed").when(F.col("rows") > 0, "failed").otherwise("pending")
    return gate.join(done, ["begins", "ends"], "left").select(F.lit(version).alias("version"), "begins", "ends", status.alias("status"))


def windows_to_ask(state: DataFrame) -> DataFrame:
    """T4: the windows that are not completed yet, in order."""
    return state.where("status <> 'completed'").select("begins", "ends").orderBy("begins")


def resume_day(rows: DataFrame, stamp: str) -> DataFrame:
    """The day to fetch again from: that of the latest stamp."""
    return rows.agg(F.to_date(F.max(stamp)).alias("resume"))
