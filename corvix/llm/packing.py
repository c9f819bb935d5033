"""Packing: documents are routed to context-size tiers, each tier is packed, long windows' gaps take shorter pieces."""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import trimmed, written
from .tokens import encoder

#: Context sizes, powers of two, longest first.
TIERS = (2048, 1024, 512, 256)
END = 1
#: Ids that a task gathers before it packs them, and that it keeps for the next ones, to have pieces of all lengths.
GATHERED, RESERVE = 1 << 20, 1 << 16
#: Ids of a step's group of sequences: the same for every tier.
STEP = 16 * TIERS[0]

#: A piece: place of its document, first id, number of ids.
Piece = tuple[int, int, int]


class Packer:
    """Packs documents into windows of the tiers' sizes.

    A document goes to the shortest tier that holds it; of one that none holds, windows of the longest tier are cut
    off first. Each tier's windows, longest tier first, begin with its longest piece that is left. What a
    window has left takes whole pieces, of its tier or shorter ones, the longest that fits first, and where
    none fits the beginning of the shortest one that is longer. So every window is full; a piece that a
    window holds is cut for a gap that nothing else fills, or where all that is left is less than its tier.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tiers
        self.pieces: list[deque[Piece]] = [deque() for _ in range(tiers[0] + 1)]
        self.lengths = 0  # bit n: there are pieces of n ids
        self.held = 0

    def route(self, doc: int, n: int) -> Iterator[tuple[int, list[Piece]]]:
        """Windows that a document fills alone; its rest is kept."""
        most, at = self.tiers[0], 0
        while n - at > most:
            yield most, [(doc, at, most)]
            at += most
        if n > at:
            self._keep((doc, at, n - at))

    def _keep(self, piece: Piece) -> None:
        self.pieces[piece[2]].append(piece)
        self.lengths |= 1 << piece[2]
        self.held += piece[2]

    def _pop(self, n: int) -> Piece:
        own = self.pieces[n]
        piece = own.popleft()
        if not own:
            self.lengths ^= 1 << n
        self.held -= n
        return piece

    def _take(self, most: int) -> Piece | None:
        """The longest piece of at most so many ids, the oldest of these."""
        n = (self.lengths & (2 << most) - 1).bit_length() - 1
        return self._pop(n) if n > 0 else None

    def _cut(self, most: int) -> Piece:
        """The first `most` ids of the shortest piece that is longer."""
        longer = self.lengths >> most + 1
        doc, at, n = self._pop((longer & -longer).bit_length() + most)
        self._keep((doc, at + most, n - most))
        return doc, at, most

    def _fill(self, size: int) -> list[Piece]:
        window, room = [], size
        while room:
            piece = self._take(room) or self._cut(room)
            window.append(piece)
            room -= piece[2]
        return window

    def pack(self, reserve: int = RESERVE) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows, tier by tier, until no more than `reserve` ids are left, or less than a window."""
        for size, shorter in zip(self.tiers, (*self.tiers[1:], 0)):
            while self.held >= max(size, reserve) and (self.lengths & (2 << size) - 1) >> shorter + 1:
                yield size, self._fill(size)

    def finish(self) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows for all that is left, the last ones of half the shortest tier's size, a quarter, ... and 1."""
        yield from self.pack(0)
        for n in range(self.tiers[0].bit_length() - 1, -1, -1):
            while self.held >= 1 << n:
                yield 1 << n, self._fill(1 << n)


PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, part int, sequence long, offset long, context int"


def _pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...], end: int, kept: int | None, with_ids: bool) -> DataFrame:
    with open(tokenizer) as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = encoder(shared.value, kept).encode, Packer(tiers)
        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}  # place: doc_id, ids, ids not yet put out
        out: list[tuple] = []
        numbers: Counter[int] = Counter()
        last = np.array([end], "<u4").tobytes()

        def put(windows: Iterator[tuple[int, list[Piece]]]) -> None:
            for size, window in windows:
                offset = 0
                for place, at, n in window:
                    doc = held[place]
                    ids = doc[1][4 * at : 4 * (at + n)]
                    out.append((doc[0], at, n, ids if with_ids else None, zlib.crc32(ids), len(doc[1]) // 4, part, numbers[size], offset, size))
                    offset += n
                    doc[2] -= n
                    if not doc[2]:
                        del held[place]
                numbers[size] += 1

        def flushed() -> Iterator[pa.RecordBatch]:
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in PIECES.split(", ")])
                out.clear()

        place = gathered = 0
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), ids_of(batch["text"])):
                ids += last
                held[place] = [doc_id, ids, len(ids) // 4]
                put(packer.route(place, len(ids) // 4))
                place += 1
                gathered += len(ids) // 4
                if gathered >= GATHERED:
                    put(packer.pack())
                    yield from flushed()
                    gathered = 0
        put(packer.finish())
        yield from flushed()
        trimmed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end: int = END, kept: int | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of packed documents: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset, context, step_group.

    A document's ids are those of its whole text by the tokenizer at path `tokenizer`, without special
    tokens, and `end`; a null or empty text has `end` alone. Each id is in one piece; ids (null without with_ids) holds
    a piece's as little-endian unsigned 32-bit integers, start counts its document's ids before it, offset its
    sequence's. A sequence has `context` ids, a power of two: a tier's size or, for the last ids of a task, fewer than
    a tier's, down to 1. So there is no padding, however many tasks there are. Sequences of each context size are numbered
    over all tasks, and step_group deals them into groups of 16 * 2048 ids, of one size; only the last group of a
    size has fewer. `kept` bounds the parts of texts whose ids a worker keeps.

    Documents are packed within their partition, about a million ids at a time, so texts aren't shuffled; what
    fills no window stays for the next million. Pieces are written as a table, from which the windows of each task
    and size are counted. Rows with a null doc_id or a repeated one are documents of their own. A text's ids are held
    by one task whole (four bytes each) until they are put out. An empty table gives no rows; other columns are ignored.
    """
    pieces = written(_pack(docs, tokenizer, tiers, end, kept, with_ids), "pieces")
    counts = pieces.groupBy("context", "part").agg((F.max("sequence") + 1).alias("n"))
    before = W.partitionBy("context").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("context", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    number = F.col("first") + F.col("sequence")
    out = pieces.join(firsts, ["context", "part"]).withColumn("step_group", F.floor(number * F.col("context") / STEP))
    sizes = F.floor(F.log2(F.col("context"))).cast("long")
    out = out.withColumn("sequence_id", number * 64 + sizes)
    return out.select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group")


def digest(docs: DataFrame, tokenizer: str, kept: int | None = None) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pack(docs, tokenizer, kept=kept, with_ids=False).drop("ids")
