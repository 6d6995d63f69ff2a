"""Whether a method at a larger stage extends one of the same name at a smaller stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.analytics import scores

#: Classes that may extend each other; shares of equal front work that decide.
DODGING, PLAIN = ("Surprise", "Delight", "Treble Bob"), ("Bob", "Place")
SURE, FIRM, PART, WEAK = 0.60, 0.45, 0.35, 0.25
SLACK = 0.18


def all_changes(notation: Column, symmetry: Column) -> Column:
    """The changes of a lead: the half before the comma, mirrored if the symmetry is palindromic, and the lead end; crosses as '-'.

    The lead end may stand first, if only what follows the comma has dividers or crosses.
    """
    parts = F.split(F.trim(F.coalesce(notation, F.lit(""))), ",")
    two, a, b = F.size(parts) == 2, F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    swapped = two & F.coalesce(~a.rlike("[.-]|x") & b.rlike("[.-]|x"), F.lit(False))
    body = F.when(swapped, b).when(two, a).otherwise(F.trim(F.coalesce(notation, F.lit(""))))
    end = F.when(swapped, a).when(two, b).otherwise("")
    half = F.transform(F.regexp_extract_all(body, F.lit("([-xX]|[^-xX.]+)"), F.lit(1)), lambda t: F.when(t.isin("x", "X"), "-").otherwise(t))
    mirrored = F.coalesce(F.lower(symmetry).contains("palindromic"), F.lit(False)) & (F.size(half) > 1)
    lead = F.when(mirrored, F.concat(half, F.reverse(F.slice(half, 1, F.greatest(F.lit(0), F.size(half) - 1))))).otherwise(half)
    return F.when(end != "", F.array_append(lead, end)).otherwise(lead)


def front(changes: Column) -> Column:
    """The places up to the fourth of each change."""
    return F.transform(changes, lambda t: F.concat(*[F.when(F.contains(t, F.lit(p)), p).otherwise("") for p in "1234"]))


def judged(pairs: DataFrame) -> DataFrame:
    """relationship, confidence, front_share of pairs (p and c: structs of a method and its changes)."""
    p, c = F.col("p"), F.col("c")
    klass = lambda m: F.coalesce(m["classification"], F.lit(""))
    hunts = lambda m: F.coalesce(m["number_of_hunts"], F.lit(0))
    sym = lambda m: F.coalesce(m["symmetry"], F.lit(""))
    odd = lambda m: m["stage"] % 2 == 1
    same = klass(p) == klass(c)
    kin = same | (klass(p).isin(*DODGING) & klass(c).isin(*DODGING)) | (klass(p).isin(*PLAIN) & klass(c).isin(*PLAIN))
    step = c["stage"] == p["stage"] + 1
    hunted = (hunts(p) == hunts(c)) | (step & (hunts(p) == 1) & (hunts(c) == 2)) | (odd(p) & ~odd(c) & (hunts(p) == 2) & (hunts(c) == 1))
    n, m = F.size(p["changes"]), F.size(c["changes"])
    fixed = n == m
    odd_growth = odd(p) & odd(c) & ((m - n == 2 * (c["stage"] - p["stage"])) | (m - n == 3 * (c["stage"] - p["stage"])) | fixed)
    step_growth = step & (m - n).isin(2, 4, 0)
    length = (F.abs(m / n - c["stage"] / p["stage"]) < SLACK) | fixed | odd_growth | step_growth
    alike = F.size(F.filter(F.zip_with(F.slice(front(p["changes"]), F.lit(1), F.least(n, m)), F.slice(front(c["changes"]), F.lit(1), F.least(n, m)), lambda x, y: x == y), lambda e: e))
    share = F.col("front_share")
    mirrored = (sym(p) == sym(c)) | (F.lower(sym(p)).contains("palindromic") & F.lower(sym(c)).contains("palindromic"))
    firm = length & (share >= FIRM) & mirrored
    pair = lambda r, k: F.struct(F.lit(r).alias("relationship"), F.lit(k).alias("confidence"))
    verdict = (
        F.when(~kin | ~hunted, pair("name_only", "high")).when((n == 0) | (m == 0), pair("name_only", "low"))
        .when(firm & same & ((share >= SURE) | fixed | odd_growth | step_growth), pair("extension", "high")).when(firm & same, pair("extension", "medium")).when(firm, pair("variant", "medium"))
        .when((share >= PART) & length, pair("variant", "medium")).when(share >= WEAK, pair("variant", "low")).otherwise(pair("name_only", "high"))
    )
    rated = pairs.withColumn("front_share", F.when((n > 0) & (m > 0), alike / F.least(n, m)).otherwise(0.0)).withColumn("v", verdict)
    return rated.select(
        p["method_id"].alias("parent_method_id"), p["stage"].alias("parent_stage"), c["method_id"].alias("child_method_id"), c["stage"].alias("child_stage"),
        p["name"].alias("family_name"), "v.relationship", "v.confidence", "front_share", p["extension_construction"].alias("parent_label"), c["extension_construction"].alias("child_label"),
    )


def extensions(methods: DataFrame) -> DataFrame:
    """Every pair of methods of one name, the parent at the smaller stage, with its verdict. Methods without a name are in none."""
    wanted = ["method_id", "name", "stage", "classification", "symmetry", "number_of_hunts", "extension_construction"]
    each = methods.where("name IS NOT NULL").select(*wanted, all_changes(F.col("notation"), F.col("symmetry")).alias("changes"))
    p, c = each.select(F.col("name").alias("pn"), F.col("stage").alias("ps"), F.struct("*").alias("p")), each.select(F.col("name").alias("cn"), F.col("stage").alias("cs"), F.struct("*").alias("c"))
    return judged(p.join(c, (F.col("pn") == F.col("cn")) & (F.col("ps") < F.col("cs"))).select("p", "c"))


def extension_scores(pairs: DataFrame) -> DataFrame:
    """A24 on pairs that are labelled on both sides: an extension is true if they share a label (blank-divided)."""
    sets = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"[\s,;/]+"), lambda x: x != "")
    known = pairs.select(sets("parent_label").alias("a"), sets("child_label").alias("b"), "relationship").where("size(a) > 0 AND size(b) > 0")
    return scores(known.select(F.arrays_overlap("a", "b").cast("int").alias("t"), (F.col("relationship") == "extension").cast("int").alias("g")), "t", "g")
