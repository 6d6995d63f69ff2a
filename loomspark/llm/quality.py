"""A byte-level convolutional network in numpy that tells text quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.ship import ship
from loomspark.llm.expressions import whole

#: Bytes of a byte filter, their step, width of a byte's embedding, filters.
KERNEL, STRIDE, WIDTH, FILTERS = 8, 4, 8, 16
#: Bytes of a chunk (its step is half), longest distance of a pair of bytes, pair filters, width of a byte's embedding there, their gain.
CHUNK, REACH, PAIRS, PAIR_WIDTH, GAIN = 64, 40, 1, 32, 16.0
#: Labelled rows of each class at most, bytes of a text at most, passes, rows of a step.
ROWS, BYTES, EPOCHS, BATCH, RATE = 700, 1 << 16, 10, 32, 0.01
#: Share of the good texts learned from that may score under `Model.least`.
GOOD_LOST = 0.002
#: Windows of a byte filter at a time; bytes that a pair filter looks at together, whole chunks.
BLOCK, PAIR_BLOCK = 1 << 14, 1 << 11


@dataclass
class Model:
    """embed (256, WIDTH), byte filters (KERNEL, WIDTH, FILTERS), pair embeddings (PAIRS, 256, PAIR_WIDTH), output weights; biases.
    least: the score from which a document is good, 0.5 or less (see `train`).

    A byte filter sees KERNEL bytes. A pair filter sees a chunk twice, as it is and some bytes
    earlier, and sums over the chunk what its embedding makes of each pair of bytes, the cosine
    of theirs. Both are learned, and of both the highest response over the whole text counts.
    """

    embed: np.ndarray
    byte: np.ndarray
    byte_bias: np.ndarray
    pair: np.ndarray
    pair_bias: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    least: float = 0.5

    @classmethod
    def fresh(cls, seed: int) -> Model:
        draw = np.random.default_rng(seed)
        some = lambda size, *shape: (draw.normal(size=shape) * size).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        return cls(some(0.3, 256, WIDTH), some(0.3, KERNEL, WIDTH, FILTERS), zero(FILTERS), some(1, PAIRS, 256, PAIR_WIDTH), zero(PAIRS) - GAIN / 2, some(0.3, FILTERS + PAIRS), zero(1))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.byte, self.byte_bias, self.pair, self.pair_bias, self.out, self.bias]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each byte adds to each byte filter at each place of a window, (KERNEL, 256, FILTERS), and what each pair adds, (PAIRS, 65536)."""
        unit = self.pair / np.linalg.norm(self.pair, axis=2, keepdims=True)
        pairs = np.einsum("paw,pbw->pab", unit, unit) * (GAIN / CHUNK)
        return np.einsum("cw,kwf->kcf", self.embed, self.byte).astype(np.float32), pairs.reshape(PAIRS, -1).astype(np.float32)


def padded(text: bytes) -> np.ndarray:
    """The text's bytes, with zeros up to whole steps of chunks, one chunk at least."""
    half = CHUNK // 2
    n = max(CHUNK, -(-len(text) // half) * half)
    x = np.zeros(n, np.uint8)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    return x


def byte_peaks(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte filter's highest response over all windows of `x`, and where that window begins."""
    best, where = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
    last = (len(x) - KERNEL) // STRIDE
    for a in range(0, last + 1, BLOCK):
        b = min(last + 1, a + BLOCK)
        part = x[a * STRIDE : (b - 1) * STRIDE + KERNEL]
        got = table[0][part[0 : (b - a - 1) * STRIDE + 1 : STRIDE]]
        for k in range(1, KERNEL):
            got += table[k][part[k : k + (b - a - 1) * STRIDE + 1 : STRIDE]]
        at = got.argmax(axis=0)
        top = got[at, np.arange(FILTERS)]
        up = top > best
        best[up], where[up] = top[up], (at[up] + a) * STRIDE
    return best, where


def pair_peaks(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair filter's highest response over all chunks of `x` and all distances from 2 to REACH, and (place, distance) of that.

    Before the text stand zeros.
    """
    half = CHUNK // 2
    best, where = np.full(PAIRS, -np.inf, np.float32), np.zeros((PAIRS, 2), np.int64)
    for a in range(0, len(x) - half, PAIR_BLOCK):
        b = min(len(x), a + PAIR_BLOCK + half)
        part = np.zeros(b - a + REACH, np.uint16)
        begin = min(a, REACH)
        part[REACH - begin :] = x[a - begin : b]
        # a row for each distance from 2 on: what stands so far before
        before = np.lib.stride_tricks.sliding_window_view(part, b - a)[REACH - 2 :: -1]
        pairs = before | part[REACH:] << 8
        for p in range(PAIRS):
            sums = np.add.reduce(table[p].take(pairs, mode="clip").reshape(REACH - 1, -1, half), axis=2)
            got = sums[:, 1:] + sums[:, :-1]
            back, at = divmod(int(got.argmax()), got.shape[1])
            if got[back, at] > best[p]:
                best[p], where[p] = got[back, at], (a + at * half, back + 2)
    return best, where


def probability(z: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(text: bytes, model: Model, tables: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability that the whole text is of quality 1."""
    x = padded(text)
    a = np.maximum(0, byte_peaks(x, tables[0])[0] + model.byte_bias)
    b = np.maximum(0, pair_peaks(x, tables[1])[0] + model.pair_bias)
    return float(probability(float(np.concatenate((a, b)) @ model.out + model.bias[0])))


def fit(texts: list[bytes], labels: list[int], weights: tuple[float, float], seed: int = 5) -> Model:
    """A model of the labels (0 or 1), by Adam on the weighted logistic loss; the maxima pass gradients to their windows alone."""
    model, draw = Model.fresh(seed), np.random.default_rng(seed)
    xs = [padded(t) for t in texts]
    behind = [np.concatenate((np.zeros(REACH, np.uint8), x)) for x in xs]
    y, w = np.array(labels, np.float32), np.array([weights[v] for v in labels], np.float32)
    parts = model.parts()
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    chunk, filters = np.arange(CHUNK), np.arange(PAIRS)
    for _ in range(EPOCHS):
        order = draw.permutation(len(xs))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            by_byte, by_pair = model.tables()
            peaks = [byte_peaks(xs[i], by_byte) for i in own]
            twins = [pair_peaks(xs[i], by_pair) for i in own]
            a = np.stack([p for p, _ in peaks]) + model.byte_bias
            b = np.stack([p for p, _ in twins]) + model.pair_bias
            windows = np.stack([xs[i][at[:, None] + np.arange(KERNEL)] for i, (_, at) in zip(own, peaks, strict=True)])
            here = np.stack([behind[i][REACH + at[:, :1] + chunk] for i, (_, at) in zip(own, twins, strict=True)])
            there = np.stack([behind[i][REACH + at[:, :1] - at[:, 1:] + chunk] for i, (_, at) in zip(own, twins, strict=True)])
            hidden = np.maximum(0, np.concatenate((a, b), axis=1))
            err = (probability(hidden @ model.out + model.bias[0]) - y[own]) * w[own] / len(own)
            back = err[:, None] * model.out * (hidden > 0)
            ga, gb = back[:, :FILTERS], back[:, FILTERS:]
            embed, pair = np.zeros_like(model.embed), np.zeros_like(model.pair)
            np.add.at(embed, windows, ga[:, :, None, None] * model.byte.transpose(2, 0, 1))
            each = (gb * (GAIN / CHUNK))[:, :, None, None]
            which = np.broadcast_to(filters[None, :, None], here.shape)
            norm = np.linalg.norm(model.pair, axis=2, keepdims=True)
            unit = model.pair / norm
            np.add.at(pair, (which, here), each * unit[which, there])
            np.add.at(pair, (which, there), each * unit[which, here])
            pair = (pair - (pair * unit).sum(axis=2, keepdims=True) * unit) / norm
            grads = [
                embed, np.einsum("bf,bfkw->kwf", ga, model.embed[windows]), ga.sum(axis=0),
                pair, gb.sum(axis=0), err @ hidden, np.array([err.sum()]),
            ]
            step += 1
            for p, g, m, v in zip(parts, grads, first, second, strict=True):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are kept from training; false without a doc_id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def least_score(scores: list[float], share: float = GOOD_LOST) -> float:
    """The highest score, up to 0.5, under which at most `share` of the `scores` of good documents are."""
    return min(0.5, sorted(scores)[int(share * len(scores))]) if scores else 0.5


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = BYTES) -> Model | None:
    """A model from `labels` (doc_id, quality) and the texts of `docs`; None if a class has no text to learn from.

    At most `rows` labelled rows of each class, none held out, with texts of at most `most` bytes,
    are taken by a hash of doc_id and learned from on the driver, whole; the loss weighs classes as
    they stand among all labels that may be learned from. Of a doc_id that repeats in `docs` one
    row is learned from, that with the smallest text hash; of one that repeats in `labels` each label.
    `Model.least` comes from the scores of the good texts learned from (`least_score`).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    order = F.xxhash64(F.lit(3), "doc_id")
    ids = [known.where(F.col("label") == v).distinct().orderBy(order, "doc_id").limit(rows) for v in (0, 1)]
    # 2 * rows rows
    sample = F.broadcast(ids[0].union(ids[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").cast("binary").alias("text")).where(F.octet_length("text") <= most)
    one = texts.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = sorted((r["doc_id"], r["label"], bytes(r["text"])) for r in one.join(sample, "doc_id").collect())
    taken = [sum(1 for g in got if g[1] == v) for v in (0, 1)]
    if not all(taken):
        return None
    total = sum(counts.values())
    weights = tuple(counts[v] / total * len(got) / taken[v] for v in (0, 1))
    model = fit([g[2] for g in got], [g[1] for g in got], weights)
    tables = model.tables()
    model.least = least_score([score(g[2], model, tables) for g in got if g[1] == 1])
    return model


def with_score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of each row of `docs` (doc_id, text), from its whole text; without a model 0.5.

    Null text: as empty, which has a score too. Null doc_id and repeated rows: a row each. Empty
    table: no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    tables = None if model is None else model.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [0.5 if model is None else score(x.as_buffer().to_pybytes(), model, tables) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model | None, least: float | None = None) -> DataFrame:
    """The rows of `docs` whose score is `least` or more, with all their columns as they are; cases as in `with_score`.

    `least`: None takes that of the model. Without a model each score is 0.5. Texts count by their
    bytes, which need not be UTF-8.
    """
    if model is None:
        return docs if least is None or least <= 0.5 else docs.limit(0)
    least = model.least if least is None else least
    ship(docs.sparkSession)
    tables = model.tables()
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [score(x.as_buffer().to_pybytes() if x.is_valid else b"", model, tables) >= least for x in b.column(at)]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
