"""Analytic operators over any keyed table; each names its key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """For each key and percentile the value at place bround(p / 100 * (n - 1)) of the ascending values.

    Ranked by a window that spills rather than by a collected list, so a key may have any number of rows.
    """
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(own.orderBy(value)) - 1).alias("at"), F.count("*").over(own).alias("n"))
    asked = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    places = ranked.select(*keys, value, "at", "n", asked).where(F.col("at") == F.bround(F.col("percent") / 100 * (F.col("n") - 1)))
    return places.select(*keys, "percent", F.col(value).alias("value"))


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each key's most common value and its count, ties by the smaller value; two-phase, no window."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(value), (-F.col("b.less")).alias("n"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each key to k before the shuffle too."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def top_or_other(df: DataFrame, group: str, k: int) -> DataFrame:
    """Counts of the k most common groups, ties by name, and of all others as 'Other'."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), group).limit(k).select(group).withColumn("top", F.lit(True))
    name = F.when(F.col("top"), F.col(group)).otherwise("Other")
    return counts.join(F.broadcast(top), group, "left").groupBy(name.alias(group)).agg(F.sum("n").alias("n"))  # k rows


def edge_bins(value: Column, edges: list[float]) -> Column:
    """The place of the first edge at or above the value, len(edges) above the last."""
    out = F.when(value <= edges[0], 0)
    for k, e in enumerate(edges[1:], 1):
        out = out.when(value <= e, k)
    return out.otherwise(len(edges)).cast("int")


def ladder(df: DataFrame, value: str, steps: list[int]) -> DataFrame:
    """Rows and sum of those with at least each threshold, in one pass."""
    sums = df.agg(*[F.sum(F.when(F.col(value) >= s, 1).otherwise(0)).alias(f"n{s}") for s in steps], *[F.coalesce(F.sum(F.when(F.col(value) >= s, F.col(value))), F.lit(0)).alias(f"t{s}") for s in steps])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("threshold"), F.col(f"n{s}").cast("long").alias("rows"), F.col(f"t{s}").cast("long").alias("total")) for s in steps]))
    return sums.select(rows.alias("r")).select("r.*")


def cumulative_curve(df: DataFrame, value: str, last: int) -> DataFrame:
    """For k from 0 to `last`, how many rows have at most k; the running sum is over the spine, not the rows."""
    counts = df.groupBy(F.col(value).cast("long").alias("k")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(last + 1).withColumnRenamed("id", "k").join(counts, "k", "left")
    return spine.select("k", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("k")).alias("at_most"))


#: Members of a block of a place.
BLOCK = 1024


def co_occurrence(df: DataFrame, place: str, member: str, least: int, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of members that share at least `least` places; members are made distinct in a place first.

    A place's members are dealt into blocks of about `block` by hash, and each pair of its blocks is joined on its
    own, so one place with very many members is spread over many tasks; the pairs themselves are the result.
    """
    once = df.select(F.col(place).alias("at"), F.col(member).alias("m")).distinct()
    sizes = once.groupBy("at").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    dealt = once.join(sizes, "at", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    a = dealt.select("at", "m", F.col("own").alias("i"), F.explode(every).alias("j")).alias("a")
    b = dealt.select("at", "m", F.col("own").alias("j"), F.explode(every).alias("i")).alias("b")
    pairs = a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.m") < F.col("b.m")))
    return pairs.groupBy(F.col("a.m").alias("a"), F.col("b.m").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def chain_links(df: DataFrame, keys: list[str], order: list[Column], member: str) -> DataFrame:
    """Each row's link to the one before it in its group."""
    before = F.lag(member).over(Window.partitionBy(*keys).orderBy(*order))
    return df.where(F.col(keys[-1]).isNotNull()).withColumn("linked", before).where("linked IS NOT NULL").select(*keys, F.col(member), "linked")


def longest_runs(df: DataFrame, key: str, order: list[Column], flag: Column) -> DataFrame:
    """The longest unbroken run of rows with the flag, for each key; 0 if none has it."""
    own = Window.partitionBy(key).orderBy(*order)
    marked = df.select(key, F.coalesce(flag, F.lit(False)).alias("on"), F.sum((~F.coalesce(flag, F.lit(False))).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    runs = marked.groupBy(key, "island").agg(F.sum(F.col("on").cast("int")).alias("run"))
    return runs.groupBy(key).agg(F.max("run").alias("longest"))


def knuth_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """The `size` rows with the smallest multiplicative hash of the key, ties by key."""
    return df.orderBy((F.col(key) * 2654435761) % 1000003, key).limit(size)


def seeded_sample(df: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """A sample that depends on the seed and the keys alone, not on partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(size)


def scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """True and false positives and negatives of two 0/1 columns, precision, recall, F1 and accuracy."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    counts = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    rate = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.select("*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
