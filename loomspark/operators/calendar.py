"""Calendar analytics: zero-filled days, seasonal baselines and days that stand out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEEKS, PEERS, RATIO, LEAST = 6, 6, 3.5, 100


def daily_counts(rows: DataFrame, date: str) -> DataFrame:
    """d and n for every day from the first to the last date of `rows`, 0 where there is none.

    The days come from a sequence of the two ends, so only as many as the span; null dates are left out.
    """
    seen = rows.where(F.col(date).isNotNull()).groupBy(F.col(date).cast("date").alias("d")).agg(F.count("*").alias("seen"))
    ends = seen.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a IS NOT NULL")
    days = ends.select(F.explode(F.sequence("a", "b")).alias("d"))
    return days.join(seen, "d", "left").select("d", F.coalesce("seen", F.lit(0)).cast("long").alias("n"))


def with_baseline(days: DataFrame, weeks: int = WEEKS, peers: int = PEERS) -> DataFrame:
    """`days` (d, n) with base: the median of the same weekday up to `weeks` weeks away on either side, itself left out.

    Days with fewer than `peers` such days inside the span, or a base of 0 or less, are left out.
    Each day meets its 2 * weeks peers by date, not every other day.
    """
    shifts = F.explode(F.array(*[F.lit(7 * k) for k in range(-weeks, weeks + 1) if k])).alias("shift")
    asked = days.select("d", "n", shifts).withColumn("peer", F.expr("date_add(d, shift)"))
    found = asked.join(days.select(F.col("d").alias("peer"), F.col("n").alias("peer_n")), "peer")
    base = found.groupBy("d", "n").agg(F.median("peer_n").alias("base"), F.count("*").alias("peers"))
    return base.where((F.col("peers") >= peers) & (F.col("base") > 0)).select("d", "n", "base", (F.col("n") / F.col("base")).alias("ratio"))


def anomalies(days: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """Days at `ratio` times their baseline or more, with `least` rows or more."""
    return with_baseline(days).where((F.col("ratio") >= ratio) & (F.col("n") >= least))


def near_misses(days: DataFrame, ratio: float = RATIO, least: int = LEAST, top: int = 8) -> DataFrame:
    """The `top` days at three quarters of the ratio or more that are no events, by ratio, then the later first."""
    found = with_baseline(days).where((F.col("ratio") >= 0.75 * ratio) & ~((F.col("ratio") >= ratio) & (F.col("n") >= least)))
    return found.orderBy(F.desc("ratio"), F.desc("d")).limit(top)


def second_sunday_of_november(years: DataFrame) -> DataFrame:
    """Year and d, the second Sunday of its November."""
    return years.select("year", F.date_add(F.next_day(F.make_date("year", F.lit(10), F.lit(31)), "Sun"), 7).alias("d"))
