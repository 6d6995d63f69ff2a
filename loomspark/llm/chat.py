"""Chat formatting of reply trees, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.materialize import settle
from loomspark.llm.expressions import let, whole

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: What a text must not say as itself, with its stand-in; the first is undone last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&nl;"))
LEARNED = "assistant"


def escape(text: Column, pairs: tuple = ESCAPES) -> Column:
    """The text without `<` and `[`, so that no control string of this template or of others is left."""
    for raw, safe in pairs:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column, pairs: tuple = ESCAPES) -> Column:
    for raw, safe in reversed(pairs):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def root_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, id, depth) of the messages on the best root-to-leaf paths; depth is 0 at the leaf.

    `messages`: tree, id, parent, score (id unique in a tree; a parent that is null or absent
    marks a root). Self-joins double the step of each round, so a path of n messages takes log2(n)
    rounds. First each message learns the length and the score of its way to the root; by these the
    `top` paths of each tree with the highest mean score are chosen (None: all), ties by the longer
    path and then the smaller leaf. Then only the chosen leaves meet their ancestors, by the same jumps. Null
    scores count as 0. Messages that reply in a ring, or lead into one, are in no path.
    """
    own = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = own.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    # up: the message 2 ** k replies up, null past the root; n and score: of the messages on the way, the own included
    now = settle(own.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("n"), "score"))
    most, rooted, going = now.count().bit_length(), now.where("up is null"), now.where("up is not null")
    jumps = [going.select("tree", "id", "up")]
    answered = jumps[0].select("tree", F.col("up").alias("id")).distinct()
    while len(jumps) <= most and not going.isEmpty():  # only ways that have not reached the root go on
        far = rooted.union(going).select(F.col("tree").alias("t"), F.col("id").alias("at"), F.col("up").alias("far"), F.col("n").alias("more"), F.col("score").alias("added"))
        met = going.join(far, (going["tree"] == far["t"]) & (going["up"] == far["at"]))
        now = settle(met.select("tree", "id", F.col("far").alias("up"), (F.col("n") + F.col("more")).alias("n"), (F.col("score") + F.col("added")).alias("score")))
        rooted, going = rooted.union(now.where("up is null")), now.where("up is not null")
        jumps.append(going.select("tree", "id", "up"))
    leaves = rooted.join(answered, ["tree", "id"], "left_anti")  # what is left over leads into a ring
    if top is not None:
        place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("n")), F.desc("n"), "id"))
        leaves = leaves.withColumn("place", place).where(F.col("place") <= top)
    pairs = leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("depth"))
    for k, jump in enumerate(jumps[:-1]):  # of the last, none is left but in rings
        pairs = settle(pairs)
        hop = jump.select(F.col("tree").alias("t"), F.col("id").alias("at"), "up")
        pairs = pairs.union(pairs.join(hop, (F.col("tree") == F.col("t")) & (F.col("id") == F.col("at"))).select("tree", "leaf", F.col("up").alias("id"), (F.col("depth") + F.lit(1 << k)).alias("depth")))
    return settle(pairs)


def format_turns(turns: Column) -> Column:
    """Struct formatted (string) and mask (array of start and length, in code points) of an array of (role, text).

    A turn is BEGIN, the escaped role, a newline, the escaped text and END. The mask marks the
    escaped texts of LEARNED turns.
    """
    safe = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(BEGIN), escape(t["role"], ROLE_ESCAPES), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    lengths = F.transform(safe, lambda t: F.struct(t["role"].alias("role"), F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body")))
    one = "array<struct<start:int,length:int>>"
    spans = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast(one).alias("out")),
        lambda a, t: F.struct(
            (a["at"] + t["head"] + t["body"] + len(END)).alias("at"),
            F.when(t["role"] == LEARNED, F.array_append(a["out"], F.struct((a["at"] + t["head"]).alias("start"), t["body"].alias("length")))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.struct(F.array_join(F.transform(safe, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"), spans.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    def turn(part: Column) -> Column:
        bare = F.substr(part, F.lit(len(BEGIN) + 1))
        return let(F.instr(bare, "\n"), lambda at: F.struct(
            unescape(F.left(bare, at - 1), ROLE_ESCAPES).alias("role"), unescape(F.substr(bare, at + 1)).alias("text")))

    parts = F.split(formatted, F.lit("<\\|im_end\\|>\n"), -1)
    return let(parts, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """tree, leaf, formatted, mask and n_turns of each chosen path (see `root_paths`) of `messages`.

    `messages`: tree, id, parent, score, role, text. One row a path: its messages from root to
    leaf as one conversation. Null role or text: empty. Empty table: no rows.
    """
    paths = root_paths(settle(messages.select("tree", "id", "parent", "score")), top)
    return format_paths(paths, messages.select("tree", "id", "role", "text"))


def format_paths(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """`format_trees` from the chosen `paths` (tree, leaf, id, depth) and `texts` (tree, id, role, text).

    Rows of `texts` that repeat tree and id are turns each, one after another by role and text. Only
    here do texts move: to the places of their messages, and from there to their paths.
    """
    said = texts.select(F.col("tree").alias("t"), F.col("id").alias("i"), whole("role").alias("role"), whole("text").alias("text"))
    joined = paths.join(said, (F.col("tree") == F.col("t")) & (F.col("id") == F.col("i")))
    grouped = joined.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("place"), "role", "text"))).alias("turns"))
    return grouped.withColumn("out", format_turns(F.col("turns"))).select("tree", "leaf", "out.formatted", "out.mask", F.size("turns").cast("long").alias("n_turns"))


def chain_texts(rows: DataFrame) -> DataFrame:
    """tree (a string, so that a null conv_id is a conversation too), id, role, text of `rows` (conv_id, turn, role, text).

    A message's id is its place in the order of turns, null first: rows with one conv_id and turn share it.
    """
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("long").cast("string")), F.lit("null"))
    turn = F.col("turn").cast("long")
    return rows.select(tree.alias("tree"), F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn")).alias("id"), F.col("role").alias("role"), F.col("text").alias("text"))


def as_chains(texts: DataFrame) -> DataFrame:
    """Thin messages (tree, id, parent, score) from `chain_texts`: each turn replies to the one before."""
    turns = texts.select("tree", "id").distinct()
    return turns.select("tree", "id", F.lag("id").over(Window.partitionBy("tree").orderBy("id")).alias("parent"), F.lit(0.0).alias("score"))


def digest_conversations(rows: DataFrame) -> DataFrame:
    """What the formatted conversations of `rows` (conv_id, turn, role, text) hold, read back from them.

    Returns conv_id, n_turns, turns_sha256 (role, newline, text, newline for each turn),
    loss_chars and loss_sha256 (the unescaped text under the mask) and formatted_chars. Null
    conv_id: one conversation. Null role or text: empty. Ties in turn are ordered by role and
    text; repeated rows are turns each; null turns come first. No LEARNED turn: loss_chars 0. Empty
    table: no rows.
    """
    texts = chain_texts(rows)
    made = format_paths(root_paths(settle(as_chains(texts))), texts)
    masked = F.array_join(F.transform("mask", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"])), "")
    said = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        made.withColumn("said", said)
        .withColumn("loss", unescape(masked))
        .select(
            F.when(F.col("tree") != "null", F.substr(F.col("tree"), F.lit(2)).cast("long")).alias("conv_id"),
            F.size("said").cast("long").alias("n_turns"),
            F.sha2(F.array_join("said", "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
