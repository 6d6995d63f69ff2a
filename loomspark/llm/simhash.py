"""SimHash fingerprints and exact near-duplicate classes by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.materialize import settle
from loomspark.functions.ship import ship
from loomspark.llm.components import components
from loomspark.llm.expressions import whole

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints that a leaf of a tree should have, that the trees are built from for each leaf (at most, and at least where
#: leaves are many), and that a cell takes of either kind; fingerprints that a leaf of a cell's own tree should have.
LEAF, SAMPLE, LEAST_SAMPLE, CELL, TINY = 16384, 32, 8, 32768, 128
#: Leaves of a tree at most, past which leaves grow and split into more cells; fingerprints that go down a tree together.
MOST_LEAVES, TOGETHER = 1 << 20, 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; no words: 0; fewer than a shingle: all of them."""
    words = text.lower().split()  # of bytes: only A-Z, and only \\x20 \\x09-\\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate(([0], ends[:-1]))
    n, ones, digest = len(words) - shingle + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, 1 << 16):
        m = min(n, k + (1 << 16))
        spans = zip(begins[k:m].tolist(), (ends[k + shingle - 1 : m + shingle - 1] - 1).tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, m - k)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's 64 bits as a signed long) of each row, from its whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) for x in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    ship(docs.sparkSession)
    text = whole("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, fp long"
    )


@dataclass
class Tree:
    """A vantage-point tree over 32-bit halves: inner nodes have a point and a distance; leaves have a number."""

    point: np.ndarray
    bound: np.ndarray
    near: np.ndarray  # the node of those at most `bound` away; negative: leaf -1 - near
    far: np.ndarray

    @classmethod
    def build(cls, sample: np.ndarray, leaves: int, seed: int) -> Tree:
        """Splits the sample at the median distance from one of its points until there are about `leaves` leaves."""
        draw, nodes, count = np.random.default_rng(seed), [], 0
        least = max(2, len(sample) // max(1, leaves))

        def grow(own: np.ndarray) -> int:
            nonlocal count
            if len(own) > 1.5 * least:
                for point in draw.choice(own, 4):
                    d = np.bitwise_count(own ^ point)
                    bound = int(np.median(d))
                    inner = d <= bound
                    if inner.all():
                        inner = d <= (bound := bound - 1)
                    if inner.any() and not inner.all():
                        nodes.append(None)
                        at = len(nodes) - 1
                        nodes[at] = (point, bound, grow(own[inner]), grow(own[~inner]))
                        return at
            count += 1
            return -count

        root = grow(sample)
        if root < 0:
            return cls(*(np.zeros(0, np.int64) for _ in range(4)))
        return cls(*(np.array([n[k] for n in nodes], np.uint32 if k == 0 else np.int64) for k in range(4)))

    def descend(self, halves: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that may hold points within `radius`; with radius 0 the one leaf of each row."""
        rows, leaves, todo = [], [], [(0 if len(self.point) else -1, np.arange(len(halves)))]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            if at < 0:
                rows.append(own)
                leaves.append(np.full(len(own), -1 - at, np.int64))
                continue
            d = np.bitwise_count(halves[own] ^ self.point[at]).astype(np.int64)
            todo.append((int(self.near[at]), own[d - radius <= self.bound[at]]))
            todo.append((int(self.far[at]), own[d + radius > self.bound[at]]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = fp.view(np.uint64)
    return (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32), (bits >> np.uint64(32)).astype(np.uint32)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the classes of a[i] and b[i]; a label is the smallest member's place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def near_edges(seek: np.ndarray, home: np.ndarray, half: int, radius: int = RADIUS, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v) of the links between `seek` and `home` (uint64) that differ in radius // 2 bits or fewer of a half.

    A tree over those at home, again, prunes what a seeker is compared with; homes that no point tells apart are compared whole.
    """
    nodes = np.unique(np.concatenate((seek, home)))
    at_seek, at_home, label = np.searchsorted(nodes, seek), np.searchsorted(nodes, home), np.arange(len(nodes))

    def compare(own: np.ndarray, there: np.ndarray) -> None:
        step = max(1, block // max(1, len(there)))
        for k in range(0, len(own), step):
            r, c = np.nonzero(np.bitwise_count(seek[own[k : k + step], None] ^ home[None, there]) <= radius)
            merge(label, at_seek[own[k + r]], at_home[there[c]])

    h = _halves(home)[half]
    tree = Tree.build(h, len(home) // TINY, 0)
    (hr, hl), (sr, sl) = tree.descend(h, 0), tree.descend(_halves(seek)[half], radius // 2)
    hr, hl = hr[o := np.argsort(hl, kind="stable")], hl[o]
    sr, sl = sr[o := np.argsort(sl, kind="stable")], sl[o]
    for leaf in range(len(tree.point) + 1):
        homes, seeks = slice(*np.searchsorted(hl, (leaf, leaf + 1))), slice(*np.searchsorted(sl, (leaf, leaf + 1)))
        compare(sr[seeks], hr[homes])
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def links(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (fp) that join all that differ in `radius` bits or fewer, none else.

    Of two fingerprints that close, one 32-bit half differs in radius // 2 bits at most. So there
    is a vantage-point tree for each half, built from a sample of SAMPLE fingerprints a leaf (of
    LEAST_SAMPLE where leaves are many: some 8 million, 67 MB) and at most MOST_LEAVES leaves (28 MB a tree). Each fingerprint has its home in one leaf of each tree
    and seeks in all leaves that the triangle bound leaves open at radius // 2. A leaf's seekers
    meet those at home in cells of about CELL by CELL, whatever their numbers, by trees of their own.
    """
    ship(distinct.sparkSession)
    leaves = int(min(MOST_LEAVES, max(1, count // LEAF)))
    each = max(LEAST_SAMPLE, min(SAMPLE, LEAST_SAMPLE * MOST_LEAVES // (2 * leaves)))
    share = max(1, count // (each * leaves))
    sample = distinct.where(F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(share)) == 0).limit(2 * each * leaves).toArrow().column("fp").to_numpy()
    sample = np.sort(sample)
    trees = [Tree.build(h, leaves, k) for k, h in enumerate(_halves(sample))]
    reach = radius // 2

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """The fingerprints of a task, TOGETHER at a time: a node is then visited once for many of them."""
        held, n = [], 0
        for b in batches:
            held.append(b.column("fp").to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= TOGETHER:
                yield np.concatenate(held)
                held, n = [], 0
        if n:
            yield np.concatenate(held)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in some(batches):
            for t, (tree, half) in enumerate(zip(trees, _halves(fp), strict=True)):
                for home in (False, True):
                    rows, leaf = tree.descend(half, 0 if home else reach)
                    for k in range(0, len(rows), 1 << 16):
                        own = slice(k, k + (1 << 16))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(fp[rows[own]]), pa.array(leaf[own] * 2 + t), pa.array(np.full(len(rows[own]), home))], names=["fp", "leaf", "home"]
                        )

    placed = settle(distinct.mapInArrow(place, "fp long, leaf long, home boolean"))
    # a row for each leaf of two trees: at most 2 * MOST_LEAVES
    sizes = placed.groupBy("leaf").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / CELL).cast("int").alias("homes"), F.ceil(F.sum((~F.col("home")).cast("int")) / CELL).cast("int").alias("seeks")
    )
    part = lambda n: F.pmod(F.xxhash64(F.lit(11), "fp"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - 1))
    cells = (
        placed.join(F.broadcast(sizes.where("homes > 0 and seeks > 0")), "leaf")
        .withColumn("h", F.when(F.col("home"), F.array(part("homes"))).otherwise(every("homes")))
        .withColumn("s", F.when(F.col("home"), every("seeks")).otherwise(F.array(part("seeks"))))
        .select("fp", "home", "leaf", F.explode("h").alias("h"), "s").select("fp", "home", "leaf", "h", F.explode("s").alias("s"))
    )

    def compare(key: tuple, cell: pa.Table) -> pa.Table:
        fp = cell.column("fp").to_numpy().view(np.uint64)
        home = cell.column("home").to_numpy(zero_copy_only=False).astype(bool)
        u, v = near_edges(fp[~home], fp[home], key[0].as_py() % 2, radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return cells.groupBy("leaf", "h", "s").applyInArrow(compare, "u long, v long")


def near_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp and first (struct none, doc_id, text_hash: the first row of its class) of each row of `docs`.

    Rows are in one class if their fingerprints link, by RADIUS or fewer bits, through any number
    of others. Equal fingerprints meet before anything is compared. Null text: as empty; texts
    without words have fingerprint 0 and link like any other. Null doc_id: comes after all
    others in its class. Repeated rows: a row each, one class. Empty table: no rows.
    """
    members = settle(fingerprints(docs))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = settle(members.groupBy("fp").agg(F.min(key).alias("first")))
    count = distinct.count()
    roots = settle(components(links(distinct.select("fp"), count, radius)))
    rooted = settle(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    best = settle(rooted.groupBy("root").agg(F.min("first").alias("first")))
    by_fp = settle(rooted.select("fp", "root").join(best, "root").select("fp", "first"))
    return members.join(by_fp, "fp")


def component_ids(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable, for each row of `docs`.

    Edge cases as in `near_classes`; component_id is null only where a class has no doc_id.
    """
    return near_classes(docs, radius).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` without those of a class but its first, by doc_id; all columns as they are.

    What goes is sought by doc_id and text hash, so texts are dealt out once. Rows that repeat
    both are one document, of which one row stays, the first by a hash of its other columns.
    Other cases as in `near_classes`.
    """
    key = {"key_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "key_none": F.col("doc_id").isNull()}
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
    gone = near_classes(docs, radius).where(~first).select(*[v.alias(k) for k, v in key.items()], F.col("text_hash").alias("key_hash"))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*plain).alias("tie"), *[v.alias(k) for k, v in key.items()], F.xxhash64(whole(docs["text"])).alias("key_hash"))
    left = rows.join(gone, [*key, "key_hash"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*key, "key_hash").orderBy("tie"))
    return left.withColumn("place", place).where("place = 1").select("row.*")
