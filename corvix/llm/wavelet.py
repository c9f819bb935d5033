"""Token files: each shard of documents is one compressed file of wavelet matrices over its token ids."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import estimated_bytes, new_path, trimmed
from .tokens import encoder

END = 2
#: Ids in a block at most; only documents with more are cut.
BLOCK = 1 << 20
#: Bits between two entries of a rank directory, and of a plane that are compressed together; one divides the other.
STRIDE, CHUNK = 1 << 12, 1 << 16
#: Ids that are moved at once, so that their places stay in a core's cache.
MOVED = 1 << 15
#: Bytes of documents' files for a shard, if there would be fewer than spark.sql.shuffle.partitions otherwise.
SHARD_BYTES = 256 << 20


class Plane:
    """Bits in chunks that are decompressed when they are read, and the ones before every STRIDE-th place, and in all."""

    def __init__(self, n: int, ranks: np.ndarray, chunks: list[bytes]) -> None:
        self.n, self.ranks, self.chunks = n, ranks, chunks
        self.zeros = n - int(ranks[-1])
        self.read: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        n, octets = len(bits), np.packbits(bits)
        ones = np.add.reduceat(np.bitwise_count(octets), np.arange(0, len(octets), STRIDE // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        packed, compress = octets.tobytes(), zstandard.ZstdCompressor(level=1).compress
        chunks = [compress(packed[at : at + CHUNK // 8]) for at in range(0, len(packed), CHUNK // 8)]
        return cls(n, np.concatenate(([0], np.cumsum(ones))).astype("<u4"), chunks)

    def bits(self, start: int, stop: int) -> np.ndarray:
        """Bits of places within one chunk, as zeros and ones; start is a multiple of eight."""
        k = start // CHUNK
        if k not in self.read:
            self.read[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.chunks[k]), np.uint8)
        at = start - k * CHUNK
        return np.unpackbits(self.read[k][at // 8 : (stop - k * CHUNK + 7) // 8], count=stop - start)

    def whole(self) -> np.ndarray:
        unpack = zstandard.ZstdDecompressor().decompress
        return np.unpackbits(np.frombuffer(b"".join(map(unpack, self.chunks)), np.uint8), count=self.n)

    def bit(self, at: int) -> int:
        first = at // 8 * 8
        return int(self.bits(first, at + 1)[at - first])

    def rank(self, at: int) -> int:
        """Ones before a place."""
        k = at // STRIDE
        return int(self.ranks[k]) + (int(self.bits(k * STRIDE, at).sum(dtype=np.int64)) if at > k * STRIDE else 0)

    def select(self, nth: np.ndarray, bit: int) -> np.ndarray:
        """Places of the nth (from 0) ones or zeros, ascending."""
        counts = self.ranks.astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * STRIDE, self.n) - counts
        if len(nth) > len(counts):
            return np.flatnonzero(self.whole() == bit)[nth]
        of, out = np.searchsorted(counts, nth, "right") - 1, np.empty(len(nth), np.int64)
        for k in np.unique(of).tolist():
            start = k * STRIDE
            own = np.flatnonzero(self.bits(start, min(start + STRIDE, self.n)) == bit)
            out[of == k] = start + own[nth[of == k] - counts[k]]
        return out


class WaveletMatrix:
    """Bit planes of a sequence of unsigned ids, highest bit first.

    Each plane orders the sequence of the plane before stably by its bit, zeros first. access, count and positions
    walk the planes by rank and select, so each reads a chunk or two of a plane; decoded() reads all.
    """

    def __init__(self, planes: list[Plane], n: int) -> None:
        self.planes, self.n = planes, n

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        n, most = len(ids), int(ids.max(initial=0))
        x = ids.astype(np.uint16 if most < 1 << 16 else np.uint32)
        planes, after = [], np.empty_like(x)
        for shift in range(max(1, most.bit_length()) - 1, -1, -1):
            bits = (x >> shift & 1).astype(bool)
            planes.append(Plane.of(bits))
            zero, one = 0, planes[-1].zeros
            for at in range(0, n if shift else 0, MOVED):  # nothing follows the last plane
                own, part = bits[at : at + MOVED], x[at : at + MOVED]
                zeros, ones = np.flatnonzero(~own), np.flatnonzero(own)
                part.take(zeros, out=after[zero : zero + len(zeros)], mode="clip")
                part.take(ones, out=after[one : one + len(ones)], mode="clip")
                zero, one = zero + len(zeros), one + len(ones)
            x, after = after, x
        return cls(planes, n)

    def access(self, at: int) -> int:
        out = 0
        for plane in self.planes:
            bit, ones = plane.bit(at), plane.rank(at)
            at = plane.zeros + ones if bit else at - ones
            out = out << 1 | bit
        return out

    def _digits(self, token: int) -> list[int]:
        return [token >> shift & 1 for shift in range(len(self.planes) - 1, -1, -1)]

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for plane, bit in zip(self.planes, self._digits(token)):
            if start >= stop:
                return 0, 0
            a, b = plane.rank(start), plane.rank(stop)
            start, stop = (plane.zeros + a, plane.zeros + b) if bit else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token in a range of places."""
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def positions(self, token: int) -> np.ndarray:
        """Places of a token, ascending."""
        a, b = self._range(token, 0, self.n)
        at = np.arange(a, b)
        if a < b:
            for plane, bit in zip(reversed(self.planes), reversed(self._digits(token))):
                at = plane.select(at - plane.zeros if bit else at, bit)
        return at

    def decoded(self) -> np.ndarray:
        """The whole sequence: planes are undone from the last to the first."""
        x = self.planes[-1].whole().astype(np.uint16 if len(self.planes) <= 16 else np.uint32)
        before = np.empty_like(x)
        for shift, plane in enumerate(self.planes[-2::-1], 1):
            bits = plane.whole().view(bool)
            zero, one = 0, plane.zeros
            for at in range(0, self.n, MOVED):
                own, part = bits[at : at + MOVED], before[at : at + MOVED]
                zeros, ones = np.flatnonzero(~own), np.flatnonzero(own)
                part[zeros], part[ones] = x[zero : zero + len(zeros)], x[one : one + len(ones)] | 1 << shift
                zero, one = zero + len(zeros), one + len(ones)
            x, before = before, x
        return x

    def to_bytes(self) -> bytes:
        """Numbers of ids and planes; each plane's rank directory and its chunks' sizes (32 bits each, little-endian); the chunks, by Zstandard."""
        head = [np.array([self.n, len(self.planes)], "<u4").tobytes()]
        for p in self.planes:
            head += [p.ranks.tobytes(), np.array([len(c) for c in p.chunks], "<u4").tobytes()]
        return b"".join([*head, *(c for p in self.planes for c in p.chunks)])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        n, planes = np.frombuffer(data, "<u4", 2).tolist()
        strides, chunks = -(-n // STRIDE) + 1, -(-n // CHUNK)
        heads = np.frombuffer(data, "<u4", planes * (strides + chunks), 8).reshape(planes, -1)
        ends = (8 + heads.nbytes + np.cumsum(heads[:, strides:].ravel(), dtype=np.int64)).tolist()
        parts = [data[a:b] for a, b in zip([8 + heads.nbytes, *ends], ends)]
        return cls([Plane(n, h[:strides], parts[k * chunks : (k + 1) * chunks]) for k, h in enumerate(heads)], n)


BLOCKS = "shard int, block int, first long, n_tokens long, doc_ids binary, no_id binary, lengths binary, before long, closes boolean, matrix binary"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _block(shard: int, number: int, first: int, docs: list[tuple[int | None, int]], before: int, closes: bool, parts: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(parts), "<u4")
    doc_ids = np.array([d or 0 for d, _ in docs], "<i8").tobytes()
    no_id = np.packbits([d is None for d, _ in docs]).tobytes()
    lengths = np.array([n for _, n in docs], "<u4").tobytes()
    row = [shard, number, first, len(ids), doc_ids, no_id, lengths, before, closes, WaveletMatrix.of(ids).to_bytes()]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names=_names(BLOCKS))


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = END) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order into token files under `path`.

    Documents are range-partitioned by doc_id; each partition is a shard and writes one file. A file is
    a Parquet container of blocks of at most a million ids: how many ids of the shard come before, the
    documents' ids and the lengths of their parts in the block, how many ids of the first are in earlier blocks, whether the last one ends, and
    the wavelet matrix with its rank directories, in compressed chunks. access(), count() and positions() read the files
    without decoding them. Null texts are empty; every document ends with `end`. Null doc_ids come
    first; rows that share one are ordered by a hash of the text and follow each other. An empty table
    gives no block.
    """
    with open(tokenizer) as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(estimated_bytes(docs) / SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = encoder(shared.value).encode, np.array([end], "<u4").tobytes()
        parts: list[bytes] = []
        listed: list[tuple[int | None, int]] = []
        room, number, before, shard, first = BLOCK, 0, 0, 0, 0
        for batch in batches:
            for shard, doc_id, ids in zip(batch["shard"].to_pylist(), batch["doc_id"].to_pylist(), ids_of(batch["text"])):
                ids += last
                at, n = 0, len(ids) // 4
                if room < n <= BLOCK:
                    yield _block(shard, number, first, listed, before, True, parts)
                    first += BLOCK - room
                    parts, listed, room, number, before = [], [], BLOCK, number + 1, 0
                while at < n:
                    took = min(room, n - at)
                    listed.append((doc_id, took))
                    parts.append(ids[4 * at : 4 * (at + took)])
                    at, room = at + took, room - took
                    if not room:
                        yield _block(shard, number, first, listed, before, at == n, parts)
                        parts, listed, room, number, first = [], [], BLOCK, number + 1, first + BLOCK
                        before = at if at < n else 0
        if listed:
            yield _block(shard, number, first, listed, before, True, parts)
        trimmed()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("at")]
    ranged = given.withColumn("at", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(run, BLOCKS).write.parquet(path)


PARTS = "doc_id long, start long, at long, n_tokens long, ids binary, ids_crc32 long, whole boolean"


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int]]:
    """Blocks of token files, and how many ids there are before each shard."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    starts, total = {}, 0
    for shard, n in sorted(map(tuple, blocks.groupBy("shard").agg(F.sum("n_tokens")).collect())):  # a number for each shard
        starts[shard] = total
        total += n
    return blocks, starts


def _looked_up(blocks: DataFrame, schema: str, found) -> DataFrame:
    """Rows of `found` (first place in all files' order, matrix) for each block."""
    names = _names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = found(row["shard"], row["first"], WaveletMatrix.from_bytes(row["matrix"]))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    return blocks.select("shard", "first", "matrix").mapInArrow(run, schema)


def access(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """(place, token): the ids at some places of all documents' ids, as start in read_tokens() counts them.

    Only the shards that have them are read; places that don't exist have no row.
    """
    blocks, starts = _opened(spark, path)
    shards, firsts = list(starts), list(starts.values())
    wanted: dict[int, list[int]] = {}
    for place in sorted({p for p in places if p >= 0}):
        at = int(np.searchsorted(firsts, place, "right")) - 1
        if at >= 0:
            wanted.setdefault(shards[at], []).append(place - firsts[at])

    def found(shard: int, first: int, matrix: WaveletMatrix) -> tuple[list[int], list[int]]:
        own = [p for p in wanted[shard] if first <= p < first + matrix.n]
        return [starts[shard] + p for p in own], [matrix.access(p - first) for p in own]

    return _looked_up(blocks.where(F.col("shard").isin(list(wanted))), "place long, token long", found)


def count(spark: SparkSession, path: str, token: int, start: int = 0, stop: int | None = None) -> int:
    """Occurrences of a token from place `start` to before `stop`."""
    blocks, starts = _opened(spark, path)

    def found(shard: int, first: int, matrix: WaveletMatrix) -> tuple[list[int]]:
        before = starts[shard] + first
        a, b = max(0, start - before), matrix.n if stop is None else min(matrix.n, stop - before)
        return ([matrix.count(token, a, b) if a < b else 0],)

    return _looked_up(blocks, "n long", found).agg(F.sum("n")).first()[0] or 0


def positions(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(place): all places of a token, in no set order."""
    blocks, starts = _opened(spark, path)

    def found(shard: int, first: int, matrix: WaveletMatrix) -> tuple[np.ndarray]:
        return (starts[shard] + first + matrix.positions(token),)

    return _looked_up(blocks, "place long", found)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents in token files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32.

    start counts the ids of all documents before. A document of several blocks is put together from its
    parts in one row, so it can have 500 million ids at most (two GB); tokens of longer ones are read by access(). Without with_ids, ids of other documents are left null. Rows come in no set order.
    """
    blocks, starts = _opened(spark, path)
    shared = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = WaveletMatrix.from_bytes(row["matrix"]).decoded().astype("<u4").tobytes()
                ends = np.cumsum(np.frombuffer(row["lengths"], "<u4").astype(np.int64)).tolist()
                begins = [0, *ends[:-1]]
                null = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=len(ends)).tolist()
                doc_ids = [None if z else d for d, z in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), null)]
                first = shared.value[row["shard"]] + row["first"]
                starts = [first + a for a in begins]
                starts[0] -= row["before"]
                at = [row["before"], *[0] * (len(ends) - 1)]
                whole = [True] * len(ends)
                whole[-1] = row["closes"]
                whole[0] = whole[0] and not row["before"]
                ids = [data[4 * a : 4 * b] for a, b in zip(begins, ends)]
                crcs = [zlib.crc32(x) for x in ids]
                if not with_ids:
                    ids = [None if all else x for x, all in zip(ids, whole)]
                columns = [doc_ids, starts, at, [b - a for a, b in zip(begins, ends)], ids, crcs, whole]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=_names(PARTS))

    def decoded(some: DataFrame) -> DataFrame:
        return some.select("shard", "first", "doc_ids", "no_id", "lengths", "before", "closes", "matrix").mapInArrow(run, PARTS)

    uncut = (F.col("before") == 0) & F.col("closes")
    names = ["doc_id", "start", "n_tokens", "ids", "ids_crc32"]
    out = decoded(blocks.where(uncut)).select(names)
    if not blocks.where(~uncut).isEmpty():
        rest = decoded(blocks.where(~uncut))
        parts = rest.where("not whole").groupBy("doc_id", "start").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
        joined = F.aggregate(F.col("parts"), F.lit(b""), lambda all, x: F.concat(all, x["ids"]))
        whole = parts.select("doc_id", "start", "n_tokens", joined.alias("ids")).withColumn("ids_crc32", F.crc32("ids"))
        out = out.unionByName(rest.where("whole").select(names)).unionByName(whole.select(names))
    return out


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document, from token files that are written and read back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs.sparkSession, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
