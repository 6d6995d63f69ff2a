"""Packing token sequences by minimum bin slack, with bitset subset sums."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.materialize import settle
from loomspark.functions.ship import ship
from loomspark.llm.expressions import whole

CAPACITY = 4096
END = 2
#: Pieces that a task holds at most; tasks whose rests are packed together; words that a worker remembers.
POOL, TOGETHER, REMEMBERED = 2048, 64, 300_000

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by one vocabulary, with a memory of words.

    The vocabulary's normalizer and splitter never look across ASCII white space, which they
    drop, so a text's ids are those of its words in turn. In a text of ASCII and Latin-1 letters
    alone, which normalization only lower-cases, the splitter's pattern is stated here over
    those characters, and a part goes to the merges at once. Equal words or parts are encoded
    once while they are remembered: what was not met in the last REMEMBERED new ones is forgotten.
    A text that says one of the vocabulary's added tokens, such as '<|endoftext|>', has the id of
    that token there, as the tokenizer gives it: such a text goes to the tokenizer whole.
    """

    _word = re.compile("[^ \t\n\r\x0b\x0c]+").findall
    _plain = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch
    _part = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+").findall

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.I).search
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.words, self.parts = Memory(self._whole), Memory(self._merged)

    @classmethod
    def of(cls, path: str | None) -> Encoder:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: str) -> bytes:
        if self._added(text):
            return self._whole(text)
        if self._plain(text):
            return self.parts.joined(self._part(text.lower()))
        return self.words.joined(self._word(text))

    def _whole(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _merged(self, part: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.merges.tokenize(part if part.isascii() else part.translate(self.letters))])


class Memory:
    """Results of a function of a string, in two generations of REMEMBERED entries."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.young, self.old = make, {}, {}

    def joined(self, keys: list[str]) -> bytes:
        young, old = self.young, self.old
        for w in set(keys).difference(young):
            young[w] = old.get(w) or self.make(w)
        out = b"".join([young[w] for w in keys])
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return out


def best_fill(counts: list[tuple[int, int]], room: int) -> dict[int, int]:
    """How many of each length fill `room` best, from (length, count) pairs; the sum is never above it.

    Bit s of an integer says whether s can be reached. Counts are taken in powers of two, so a
    length costs the logarithm of its count. It ends early once `room` itself is reached; the
    counts come from going back through the steps.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, count in counts:
        part = 1
        count = min(count, room // length)
        while count:
            part = min(part, count)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            count -= part
            part *= 2
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> left & 1:
            used[length] = used.get(length, 0) + part
            left -= length * part
    return used


class Pool:
    """Pieces (doc_id, start, ids, doc_tokens) below the capacity, by length."""

    def __init__(self, capacity: int):
        self.capacity, self.by, self.lengths, self.count, self.tokens = capacity, {}, [], 0, 0

    def add(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if n not in self.by:
            self.by[n] = []
            insort(self.lengths, n)
        self.by[n].append(piece)
        self.count, self.tokens = self.count + 1, self.tokens + n

    def take(self, n: int) -> tuple:
        piece = self.by[n].pop()
        if not self.by[n]:
            del self.by[n]
            self.lengths.pop(bisect_left(self.lengths, n))
        self.count, self.tokens = self.count - 1, self.tokens - n
        return piece

    def window(self) -> list[tuple]:
        """The longest piece and those that leave least room beside it; what room is left takes the head of another piece."""
        own = [self.take(self.lengths[-1])]
        room = self.capacity - len(own[0][2]) // 4
        if room and self.count:
            fit = reversed(self.lengths[: bisect_right(self.lengths, room)])
            for n, k in best_fill([(n, len(self.by[n])) for n in fit], room).items():
                own += [self.take(n) for _ in range(k)]
                room -= n * k
            if room and (at := bisect_right(self.lengths, room)) < len(self.lengths):
                doc, start, ids, total = self.take(self.lengths[at])
                own.append((doc, start, ids[: 4 * room], total))
                self.add((doc, start + room, ids[4 * room :], total))
        return own


class Rows:
    """Rows of output, in columns."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in range(8)]

    def put(self, sequence: int | None, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            rest = None if sequence is not None else ids
            for c, v in zip(self.columns, (doc, start, n, zlib.crc32(ids), total, sequence, offset, rest), strict=True):
                c.append(v)
            offset += n

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)], names=[x.split()[0] for x in COLUMNS.split(", ")] + ["ids"])
        self.columns = [[] for _ in range(8)]
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the token ids of each row of `docs` (doc_id, text) in sequences of at most `capacity` ids.

    A document's ids, from its whole text, end with END. It is cut into full sequences and a
    rest. A task keeps rests in a pool of about POOL and fills sequences by `Pool.window`, full
    to the last id, until less than one sequence is left; the rests of TOGETHER tasks are then
    packed the same way, so only the last sequence of so many tasks has padding.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null text: as
    empty, one id. Bytes that are not UTF-8: as U+FFFD. Null doc_id and repeated rows: packed like any other. Empty table: no rows.
    An added token's string in a text: its id, see `Encoder`. Other columns are ignored. `tokenizer`: the path of a vocabulary file, the same on every
    machine; None: the public 49k word vocabulary.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pool, rows = Encoder.of(tokenizer), Pool(capacity), Rows()
        task, number, end = TaskContext.get().partitionId(), 0, END.to_bytes(4, "little")

        def put(pieces: list[tuple]) -> None:
            nonlocal number
            rows.put((task << 33 | number) << 1, pieces)
            number += 1

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encoder.encode(str(text.as_buffer(), "utf8", "replace")) + end
                total, full = len(ids) // 4, len(ids) // (4 * capacity)
                for k in range(full):
                    put([(doc, k * capacity, ids[4 * k * capacity : 4 * (k + 1) * capacity], total)])
                if total > full * capacity:
                    pool.add((doc, full * capacity, ids[4 * full * capacity :], total))
                if pool.count >= POOL:
                    while pool.count > POOL // 2 and pool.tokens >= capacity:
                        put(pool.window())
            yield rows.batch()
        while pool.tokens >= capacity:
            put(pool.window())
        while pool.count:
            rows.put(None, [pool.take(pool.lengths[-1])])
        yield rows.batch()

    def rest(key: tuple, table: pa.Table) -> pa.Table:
        pool, rows, number = Pool(capacity), Rows(), 0
        columns = [table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
        for piece in sorted(zip(*columns, strict=True), key=lambda p: (p[0] is None, p[0] or 0, p[1], p[2])):
            pool.add(piece)
        while pool.count:
            rows.put((key[0].as_py() << 33 | number) << 1 | 1, pool.window())
            number += 1
        return pa.Table.from_batches([rows.batch()]).drop_columns(["ids"])

    ship(docs.sparkSession)
    placed = settle(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
        .mapInArrow(first, COLUMNS + ", ids binary")
        .withColumn("batch", (F.spark_partition_id() / TOGETHER).cast("long"))
    )
    rests = placed.where("sequence_id is null").groupBy("batch").applyInArrow(rest, COLUMNS)
    return placed.where("sequence_id is not null").drop("ids", "batch").unionByName(rests)
