"""Place notation as array expressions: changes, leads, course heads and what makes them false or musical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bell symbols in order of place.
ORDER = "1234567890ETABCD"
CROSS = ("-", "x", "X")


def place_of(symbol: Column) -> Column:
    """K1: the 0-based place of a symbol, in either case; null if it is none."""
    at = F.position(F.upper(symbol), F.lit(ORDER))
    return F.when((F.length(symbol) == 1) & (at > 0), at - 1)


def rounds(stage: Column) -> Column:
    """The bells of a stage in order, as an array of symbols."""
    return F.slice(F.split(F.lit(ORDER), ""), F.lit(1), stage.cast("int"))


def split_changes(notation: Column) -> Column:
    """K2: the changes of a notation; a cross stands alone, dots divide the others, white space counts for nothing."""
    return F.regexp_extract_all(F.regexp_replace(notation, r"\s+", ""), F.lit(r"([-xX]|[^-xX.]+)"), F.lit(1))


def apply_change(row: Column, change: Column) -> Column:
    """K3: named places stay, neighbours free on both sides swap from the front, a bell left over stays."""
    cross = change.isin(*CROSS)
    free = lambda i: cross | (F.position(F.substr(F.lit(ORDER), i + 1, F.lit(1)), F.upper(change)) == 0)
    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("swapped"))

    def step(a: Column, i: Column) -> Column:
        swaps = ~a["swapped"] & free(i) & (i + 1 < F.size(row)) & free(i + 1)
        bell = F.when(a["swapped"], F.get(row, i - 1)).when(swaps, F.get(row, i + 1)).otherwise(F.get(row, i))
        return F.struct(F.array_append(a["out"], bell).alias("out"), swaps.alias("swapped"))

    return F.aggregate(F.sequence(F.lit(0), F.size(row) - 1), none, step, lambda a: a["out"])


def _part(notation: Column, k: int) -> Column:
    return split_changes(F.get(F.split(notation, ","), F.lit(k)))


def _reverse(a: Column, drop: str | None) -> Column:
    kept = F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1)) if drop == "last" else F.slice(a, 2, F.greatest(F.lit(0), F.size(a) - 1)) if drop == "first" else a
    return F.reverse(kept)


#: How the short form A,B stands for a lead.
EXPANSIONS = {
    "mirror_drop_last": lambda a, b: F.concat(a, _reverse(a, "last"), b),
    "mirror_full": lambda a, b: F.concat(a, _reverse(a, None), b),
    "mirror_drop_first": lambda a, b: F.concat(a, _reverse(a, "first"), b),
    "b_between": lambda a, b: F.concat(a, b, _reverse(a, "last")),
}


def expand(notation: Column, rule: str = "mirror_drop_last") -> Column:
    """K4: all changes of a lead; without a comma the changes as they are, past a second comma nothing."""
    plain = ~F.contains(notation, F.lit(","))
    return F.when(plain, split_changes(notation)).otherwise(EXPANSIONS[rule](_part(notation, 0), _part(notation, 1)))


def lead_rows(notation: Column, stage: Column, rule: str = "mirror_drop_last", start: Column | None = None) -> Column:
    """K5: the rows of a lead from rounds (or `start`), which is the first, each an array of symbols."""
    first = rounds(stage) if start is None else start
    return F.aggregate(expand(notation, rule), F.array(first), lambda rows, c: F.array_append(rows, apply_change(F.element_at(rows, -1), c)))


def lead_head(notation: Column, stage: Column, rule: str = "mirror_drop_last") -> Column:
    """K5: the row at the lead's end, joined."""
    return F.array_join(F.aggregate(expand(notation, rule), rounds(stage), apply_change), "")


def rule_scores(methods: DataFrame) -> DataFrame:
    """K6: for each rule the methods (notation, stage, lead_head) and how many of their heads it gives."""
    one = lambda rule: methods.agg(F.count("*").alias("methods"), F.count_if(lead_head(F.col("notation"), F.col("stage"), rule) == F.col("lead_head")).alias("right")).select(F.lit(rule).alias("rule"), "methods", "right")
    out = one("mirror_drop_last")
    for rule in list(EXPANSIONS)[1:]:
        out = out.union(one(rule))
    return out


def called_lead(body: Column, call: Column, stage: Column) -> Column:
    """K7: the rows after the first of a lead with a call at its end; the body is what stands before a single comma."""
    parts = F.split(body, ",")
    whole = F.concat(F.when(F.size(parts) == 2, parts[0]).otherwise(body), F.lit(","), call)
    rows = lead_rows(whole, stage)
    return F.slice(rows, 2, F.size(rows) - 1)


def truth(blocks: DataFrame) -> DataFrame:
    """K8: composition and whether no row stands twice in its blocks (composition, row)."""
    return blocks.groupBy("composition").agg((F.count("row") == F.count_distinct("row")).alias("true"))


def course_heads(spark: SparkSession, stage: int) -> DataFrame:
    """K9: head (array) for all (stage - 1)! orders of the other bells behind the treble, grown a bell at a time."""
    bells = F.array(*[F.lit(b) for b in ORDER[:stage]])
    heads = spark.range(1).select(F.array(F.lit(ORDER[0])).alias("head"))
    for _ in range(stage - 1):
        heads = heads.select("head", F.explode(F.array_except(bells, F.col("head"))).alias("b")).select(F.array_append("head", F.col("b")).alias("head"))
    return heads


def transpose(head: Column, lead_end: Column, stage: int) -> Column:
    """The head that a lead ending in `lead_end` from rounds leads to from `head`."""
    first = F.array(*[F.lit(b) for b in ORDER[:stage]])
    return F.transform(lead_end, lambda b: F.element_at(head, F.array_position(first, b).cast("int")))


def transitions(heads: DataFrame, body: str, calls: dict[str, str], stage: int) -> DataFrame:
    """K9: head, call and next_head for each head and call."""
    ends = F.array(*[F.struct(F.lit(name).alias("call"), F.element_at(called_lead(F.lit(body), F.lit(call), F.lit(stage)), -1).alias("end")) for name, call in calls.items()])
    return heads.select(F.col("head").alias("bells"), F.explode(ends).alias("c")).select(
        F.array_join("bells", "").alias("head"), F.col("c.call").alias("call"), F.array_join(transpose(F.col("bells"), F.col("c.end"), stage), "").alias("next_head"))


def head_rows(heads: DataFrame, body: str, plain: str, stage: int) -> DataFrame:
    """head, place and row of the plain lead from each head."""
    lead = called_lead(F.lit(body), F.lit(plain), F.lit(stage))
    return heads.select(F.col("head").alias("bells"), F.posexplode(lead).alias("place", "turn")).select(
        F.array_join("bells", "").alias("head"), "place", F.array_join(transpose(F.col("bells"), F.col("turn"), stage), "").alias("row"))


def false_heads(rows: DataFrame) -> DataFrame:
    """Pairs of different heads that share a row; a row has one head for each place, so no group grows."""
    a, b = rows.select("head", "row").distinct().alias("a"), rows.select("head", "row").distinct().alias("b")
    return a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.head") != F.col("b.head"))).select(F.col("a.head").alias("head"), F.col("b.head").alias("false_head")).distinct()


#: Fixed values by stage: the course end that counts, and the row that counts most.
MUSIC = {6: ("56", "142536"), 8: ("5678", "15263748"), 10: ("7890", "1627384950")}
OTHER_MUSIC = ("567", "142536")


def musicality(rows: DataFrame, stage: int) -> DataFrame:
    """Head and score of its rows (head, place, row); long parting of the two tenors costs from 8 bells on."""
    end, best = MUSIC.get(stage, OTHER_MUSIC)
    row = F.col("row")
    part = F.when(row.contains(end), 1.0).otherwise(0.0) + F.when(row.startswith("1234"), 2.0).otherwise(0.0) + F.when(row == best, 5.0).otherwise(0.0)
    if stage == 8:
        part = part + F.when(row.endswith("8765"), 2.0).when(row.endswith("5678"), 1.5).otherwise(0.0)
    scored = rows.groupBy("head").agg(F.sum(part).alias("score"))
    if stage < 8:
        return scored
    apart = F.abs(F.instr(row, "7") - F.instr(row, "8")) > 1
    own = Window.partitionBy("head").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.select("head", apart.alias("apart"), F.sum((~apart).cast("int")).over(own).alias("island")).groupBy("head", "island").agg(F.sum(F.col("apart").cast("int")).alias("run"))
    longest = runs.groupBy("head").agg(F.max("run").alias("run"))
    return scored.join(longest, "head").select("head", (F.col("score") - F.greatest(F.lit(0), F.col("run") - 50) * 0.1).alias("score"))
