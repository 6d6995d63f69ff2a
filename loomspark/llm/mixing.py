"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.materialize import settle
from loomspark.llm.expressions import let, whole
from loomspark.llm.ordering import RANGE, into_ranges

WEIGHTS = (5, 2, 1)
#: Copies of a document at most; longest documents of a source that are settled one after another.
MOST, FOLD = 3, 512


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null: 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+", -1))).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, from 0 to below 1: the first 32 bits of an MD5 digest."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(counts: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source of `counts` (source, RANGE, rows, size): source, rows, source_size, weight, target.

    `counts` has a row for each source and range that meet, the ranges being in the order of the
    sources by code point, null last. In that order sources weigh `weights`, repeating; a source's
    place comes from the sources that begin in earlier ranges. A target stops at `most` times its
    source's size and the excess is shared anew by weight until none is above: the level (target
    a unit of weight) rises round by round, by aggregations over sources, until no more sources stop.
    Nothing but totals comes to the driver. A source without words: target 0.
    """
    sums = counts.groupBy("source").agg(F.sum("rows").alias("rows"), F.sum("size").alias("source_size"), F.min(RANGE).alias(RANGE))
    begun = sums.groupBy(RANGE).agg(F.count("*").alias("n"))
    # a row for each range in which a source begins: windows and broadcasts over them are bounded by shuffle partitions
    before = begun.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = Window.partitionBy(RANGE).orderBy(F.col("source").asc_nulls_last())
    rank = (F.col("before") + F.row_number().over(inside) - 1) % len(weights)
    ranked = settle(
        sums.join(F.broadcast(before), RANGE)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank + 1).cast("int")))
        .select("source", "rows", "source_size", "weight")
    )
    room = most * F.col("source_size")
    level, stopped = 0.0, None
    while True:
        full = F.lit(False) if stopped is None else level * F.col("weight") > room
        t = ranked.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(full, room)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weights"), F.sum(full.cast("long")).alias("n")
        ).first()
        if t["weights"] is None or t["n"] == stopped:
            break
        level, stopped = (t["total"] - (t["held"] or 0)) / t["weights"], t["n"]
    return ranked.withColumn("target", F.least(room.cast("double"), F.lit(level) * F.col("weight")))


def fold_longest(longest: Column, size: Column, target: Column, phase: Column, most: int) -> Column:
    """Copies of a source's longest documents, in turn, and what they leave: struct n (array), left, size, sum.

    Each document expects what is left of the target over what is left of the words, but no more
    copies than fit into what is left, and no fewer than leave what all after it can make up (from 0
    to `most`). The prefix sum of that plus the random offset `phase` gives a copy for each integer
    crossed. So what one document took too much or too little is shared by all after it.
    """
    def expected(a: Column, s: Column) -> Column:
        fit = F.floor(a["left"] / s).cast("double")
        need = F.ceil((a["left"] - most * (a["size"] - s)) / s).cast("double")
        return F.when(s > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), need, F.least(a["left"] / a["size"], fit)))).otherwise(0.0)

    def step(a: Column, s: Column) -> Column:
        def taken(b: Column) -> Column:
            n = (F.floor(b["sum"] + b["e"]) - F.floor(b["sum"])).cast("long")
            return let(n, lambda n: F.struct(
                F.array_append(b["n"], n).alias("n"), (b["left"] - (n * s).cast("double")).alias("left"), (b["size"] - s).alias("size"), (b["sum"] + b["e"]).alias("sum")))

        return let(F.struct(a["n"].alias("n"), a["left"].alias("left"), a["size"].alias("size"), a["sum"].alias("sum"), expected(a, s).alias("e")), taken)

    start = F.struct(F.array().cast("array<long>").alias("n"), target.alias("left"), size.alias("size"), phase.alias("sum"))
    return F.aggregate(longest, start, step)


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, fold: int = FOLD) -> DataFrame:
    """Copies of each row of `docs` (doc_id, text, source): doc_id, size, source, source_size, target, copies, taken.

    Within a source documents come longest first, ties by doc_id. Each expects a number of copies
    from 0 to `most`; with the prefix sum of expected copies plus one random offset of the source, a
    document is emitted once for each integer boundary crossed. The `fold` longest documents (one at least)
    expect what is left of the target over the words that are left, one after another and within
    what still leads to the target (`fold_longest`); all others expect what these leave over the
    words they leave. So the words taken differ from the target by less than the longest of the
    others, at most 1 / (fold + 1) of the source's words; where there are no others, by what the
    shortest ones cannot make up.

    A global place comes from ranges: the rank inside a range plus the totals of the ranges
    before it, so a source with a third of all rows spreads over many tasks. Rows that are equal
    in all of source, size and doc_id may change places with each other, which gives the same rows.

    Null text or no words: size 0 and 0 words taken. Null source: a source of its own, the last.
    Null doc_id: last in its size. Empty table: no rows. Other columns are ignored.
    """
    thin = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    return place_copies(thin, seed, weights, most, fold)


def place_copies(thin: DataFrame, seed: int, weights: tuple[int, ...], most: int, fold: int) -> DataFrame:
    """`mix` from settled rows (doc_id, source, size, any others, which are kept)."""
    by_size = [F.col("size").desc(), F.col("doc_id").desc()]
    ranged = into_ranges(thin, [F.col("source").asc_nulls_last(), *by_size])
    counts = settle(ranged.groupBy("source", RANGE).agg(F.count("*").alias("rows"), F.sum("size").alias("size")))
    targets = source_targets(counts, weights, most)
    earlier = Window.partitionBy("source").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", RANGE, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("source", RANGE).orderBy(*by_size)
    ranked = ranged.withColumn("in_range", F.row_number().over(inside))
    met = ranked.alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col(f"d.{RANGE}") == F.col(f"s.{RANGE}")))
    placed = settle(met.select(*[F.col(f"d.{c}") for c in thin.columns], (F.col("s.rows_before") + F.col("d.in_range")).alias("place")))
    # at most `fold` sizes a source
    sizes = placed.where(F.col("place") <= fold).groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "size"))), lambda x: x["size"]).alias("longest"))
    t, z = targets.alias("t"), sizes.alias("z")
    folded = F.col("folded")
    sources = settle(
        t.join(z, F.col("t.source").eqNullSafe(F.col("z.source")))
        .withColumn("folded", fold_longest(F.col("z.longest"), F.col("t.source_size"), F.col("t.target"), offset(F.col("t.source"), seed), most))
        .select(
            "t.source", "t.source_size", "t.target", folded["n"].alias("first"), folded["sum"].alias("phase"),
            F.when(folded["size"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), folded["left"] / folded["size"]))).otherwise(0.0).alias("expected"),
        )
    )
    own = [F.col(f"d.{c}") for c in thin.columns]
    crossed = lambda n: F.floor(n * F.col("s.expected") + F.col("s.phase"))
    place = F.col("d.place")
    n = F.when(place <= fold, F.get(F.col("s.first"), (place - 1).cast("int"))).otherwise(crossed(place - fold) - crossed(place - fold - 1)).cast("long")
    return (
        placed.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select(*own, "s.source_size", "s.target", n.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
    )


def take_copies(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, fold: int = FOLD) -> DataFrame:
    """The rows of `docs`, each as often as `mix` takes it, with all their columns as they are.

    Copies are found on thin rows and meet the texts by doc_id, source and text hash, so texts are
    dealt out once. Rows that repeat all three share the copies of all of them evenly, the first
    by a hash of their other columns having one more. Other cases as in `mix`.
    """
    key = {"key_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "key_none": F.col("doc_id").isNull(), "key_source": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))}
    key = {k: v.alias(k) for k, v in key.items()} | {"key_hash": F.xxhash64(whole(docs["text"])).alias("key_hash")}
    thin = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *key.values()))
    taken = settle(place_copies(thin, seed, weights, most, fold).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*plain).alias("tie"), *key.values()).join(taken, list(key))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("tie"))
    n = F.floor(F.col("copies") / F.col("rows")).cast("long") + (F.col("place") <= F.col("copies") % F.col("rows")).cast("long")
    own = rows.withColumn("place", place).select("row", n.alias("n")).where("n > 0")
    return own.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")
