"""Quality rules as a short-circuit cascade, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.expressions import let, whole, words

WINDOW = 5
#: Texts of the sample, their characters at most, times that each rule runs on each.
SAMPLE_ROWS, SAMPLE_CHARS, REPEATS = 256, 65536, 8


def n_repeat_words(w: Column) -> Column:
    """Words of the array `w` in WINDOW-word windows that stand twice or more in it, the first included.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. If all differ, which one
    hash set tells, the answer is 0; else equal hashes meet by sorting, and the covered places
    are summed from left to right. Linear, but for the sort, also in very long texts.
    """
    def covered(wins: Column) -> Column:
        pairs = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(twin(x, k), x["i"])), lambda p: p.isNotNull()))

        return F.aggregate(
            let(pairs, places),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    def windows(hw: Column) -> Column:
        return F.transform(
            F.slice(hw, 1, F.size(hw) - (WINDOW - 1)),
            lambda h, i: F.xxhash64(h, *[F.get(hw, i + k) for k in range(1, WINDOW)]),
        )

    some = let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda hw: let(windows(hw), lambda wins: F.when(F.size(F.array_distinct(wins)) == F.size(wins), 0).otherwise(covered(wins))),
    )
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(some).cast("long")


def n_symbols(text: Column) -> Column:
    """Characters `[#*$%&|<>]`."""
    return (F.size(F.split(text, "[#*$%&|<>]", -1)) - 1).cast("long")


def filled_lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(filled_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def word_chars(w: Column) -> Column:
    """Code points in the words of the array `w`."""
    return F.length(F.array_join(w, "")).cast("long")


@dataclass(frozen=True)
class Facts:
    """What rules may ask of a text; nothing is computed before a rule that asks for it is reached."""

    text: Column
    words: Column

    def n_words(self) -> Column:
        return F.size(self.words)

    def n_repeat_words(self) -> Column:
        return n_repeat_words(self.words)

    def n_symbols(self) -> Column:
        return n_symbols(self.text)

    def word_chars(self) -> Column:
        return word_chars(self.words)


class Counted(Facts):
    """Facts that stand in columns already."""

    def n_words(self) -> Column:
        return F.col("n_words")

    def n_repeat_words(self) -> Column:
        return F.col("n_repeat_words")

    def n_symbols(self) -> Column:
        return F.col("n_symbols")

    def word_chars(self) -> Column:
        return F.col("word_chars")


@dataclass(frozen=True)
class Rule:
    """rejects: from the facts of a text to a condition, true for a text to reject."""

    name: str
    rejects: Callable[[Facts], Column]


def _stutters(f: Facts) -> Column:
    same = lambda v: F.size(F.filter(F.transform(v, lambda x, i: x == F.get(v, i + 1)), lambda y: y))
    return let(f.words, lambda v: 10 * same(v) > 3 * F.size(v))


RULES = (
    Rule("few_words", lambda f: f.n_words() < 10),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words() > 20 * f.n_words()),
    Rule("symbols", lambda f: 10 * f.n_symbols() > 3 * f.n_words()),
    Rule("exclaimed", lambda f: 10 * (F.size(F.split(f.text, "!!", -1)) - 1) > 3 * f.n_words()),
    Rule("word_length", lambda f: ~let(f.word_chars(), lambda n: (2 * n).between(3 * f.n_words(), 40 * f.n_words()))),
    Rule("repeated_lines", lambda f: let(filled_lines(f.text), lambda x: (F.size(x) >= 4) & (10 * F.size(F.array_distinct(x)) < 5 * F.size(x)))),
    Rule("stuttered", _stutters),
)


def _nanoseconds() -> Column:
    """The clock of the worker where and when this is evaluated."""
    return F.expr("reflect('java.lang.System', 'nanoTime')").cast("long")


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, repeats: int = REPEATS) -> list[tuple[Rule, float, float]]:
    """The rules by rejection per cost, best first, with the rate and the seconds a text that gave the order.

    Both come from a sample of at most `rows` rows, taken by a hash of doc_id over all of `docs`, with
    texts of at most `chars` characters. One job takes it and runs each rule alone on each of its
    texts `repeats` times between two looks at the clock; a text's cost is the least of these. Ties and rules of no rejection keep the order given. The order decides what is
    computed, never which texts are rejected: a text goes if any rule rejects it, whatever the order.
    """
    text = whole("text")
    thinned = F.pmod("hash", F.lit(max(1, docs.count() // (2 * rows)))) == 0  # about twice as many as are wanted, whatever the number of partitions
    sample = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("hash"), text.alias("text")).where(thinned & (F.length("text") <= chars)).orderBy("hash", "text").limit(rows)
    again = sample.select("text", words(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("row")).withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    facts = Facts(F.col("text"), F.col("words"))
    seen = [F.struct(_nanoseconds().alias("a"), r.rejects(facts).cast("int").alias("rejected"), _nanoseconds().alias("b")) for r in rules]
    found = (
        again.select("row", F.posexplode(F.array(*seen)).alias("rule", "x"))
        .groupBy("row", "rule").agg(F.min(F.col("x.b") - F.col("x.a")).alias("cost"), F.max("x.rejected").alias("rejected"))
        .groupBy("rule").agg(F.avg("rejected").alias("rate"), (F.avg("cost") / 1e9).alias("cost")).collect()
    )
    rate, cost = {x["rule"]: x["rate"] for x in found}, {x["rule"]: x["cost"] for x in found}
    measured = [(r, rate.get(k, 0.0), max(cost.get(k, 0.0), 1e-9)) for k, r in enumerate(rules)]
    return sorted(measured, key=lambda x: -x[1] / x[2])


def first_failure(facts: Facts, ordered: list[Rule]) -> Column:
    """The name of the first rule that rejects the text, later ones not being evaluated; null if none does."""
    out = F.when(ordered[0].rejects(facts), F.lit(ordered[0].name))
    for r in ordered[1:]:
        out = out.when(r.rejects(facts), F.lit(r.name))
    return out


def keep_by_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that no rule rejects, with all their columns as they are.

    Null text: as empty, so rejected by few_words. Repeated rows: each is judged alike. Empty
    table: no rows. Nulls in other columns and other columns of any name don't matter.
    """
    ordered = [r for r, _, _ in order_rules(docs, rules)]
    text = whole(docs["text"])
    return docs.where(let(words(text), lambda w: first_failure(Facts(text, w), ordered)).isNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and the verdict for each row of `docs` (doc_id, text), whose whole text counts.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and
    kept: false if base_failed, else the cascade's verdict. Which rule rejected first is not told, as that hangs on measured costs. Null text: no words, so not kept. Null
    doc_id and repeated rows: a row each. Empty table: no rows. Other columns are ignored.
    """
    ordered = [r for r, _, _ in order_rules(docs, rules)]
    text, w = F.col("text"), F.col("words")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
        .withColumn("words", words(text))
        .select(
            "doc_id", "text", "words", F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"),
            n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"),
        )
        .select("doc_id", *counts, first_failure(Counted(text, w), ordered).isNull().alias("passes"))
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select("doc_id", *counts, base.alias("base_failed"), (~base & F.col("passes")).alias("kept"))
