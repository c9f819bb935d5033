"""Language-model scoring by prediction by partial matching over byte contexts, beside a word-count baseline."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_bytes, released, trimmed, written

#: Bytes of the longest context.
ORDER = 5
#: Contexts with their symbols that are worked out together, if no context of CLASS bytes has more.
GRAMS = 500_000
#: Bytes that all contexts of a class share: a class has at most 256 ** (ORDER - CLASS + 1) contexts with their symbols.
CLASS = 3
#: Distinct contexts of a block that are gathered before equal ones are summed up.
GATHERED = 1_000_000
#: Bytes of texts worked on at once, if no text is longer.
SLICE = 1 << 19
#: Bytes of texts in a block of documents.
BLOCK_BYTES = 64 << 20
#: Tasks over the blocks at most; each takes its blocks one after another.
TASKS = 20_000
#: What stands before a text and ends it; neither byte occurs in UTF-8.
START, STOP = 0xFE, 0xFF
SYMBOLS = 255


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def windows(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of the texts with the `order` bytes before it, as one number, and where each text starts.

    A text's symbols are its words, A-Z lower-cased, with single spaces between them, and STOP.
    """
    start = bytes([START]) * order
    joined = [b" ".join(words_of(t)) for t in texts]
    data = np.frombuffer(b"".join(start + t + bytes([STOP]) for t in joined), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in joined], np.int64)
    out = data[order:].copy()
    for k in range(1, order + 1):
        out |= data[order - k : len(data) - k] << np.uint64(8 * k)
    begins = np.concatenate(([0], np.cumsum(sizes + order)[:-1]))
    keep = np.ones(len(out), bool)
    for k in range(order):  # windows whose last byte is a START
        at = begins[1:] - order + k
        keep[at] = False
    return out[keep], np.concatenate(([0], np.cumsum(sizes)[:-1]))


def sliced(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= SLICE):
            size += len(texts[end] or b"")
            end += 1
        yield [t or b"" for t in texts[at:end]]
        at = end


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    g, c = np.concatenate(grams), np.concatenate(counts)
    at = np.argsort(g, kind="stable")
    g, c = g[at], c[at]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    return g[first], np.add.reduceat(c, first) if len(g) else c


class Trie:
    """Contexts of 0 to `order` bytes and their symbols' counts, with PPM code lengths worked out.

    A context with n symbols, d distinct ones, codes a symbol seen c times as c / (n + d) and an escape as
    d / (n + d). After an escape the next shorter context is used without the symbols of the one
    before (all of which it has); after the empty context the symbols left are alike. As a context's
    symbols are those that its extension excludes, the divisor after an escape is a number of the
    extension alone: `past` has its logarithm, `passed` that of a further escape.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> None:
        """grams, counts: sorted longest contexts with symbols, of whole classes; low: the shorter ones, of less than CLASS bytes.

        Of low the last need not have more than the contexts that the classes end with.
        """
        self.order = order
        self.grams: list[np.ndarray] = [np.zeros(0, np.uint64)] * (order + 1)
        self.contexts: list[np.ndarray] = [np.zeros(0, np.uint64)] * (order + 1)
        seen: list[np.ndarray] = [np.zeros(0)] * (order + 1)
        for k in range(order, -1, -1):
            if k == order:
                self.grams[k], seen[k] = grams, counts
            elif k >= len(low):
                self.grams[k], seen[k] = _summed([self.grams[k + 1] & _mask(k + 1)], [seen[k + 1]])
            else:
                self.grams[k], seen[k] = low[k]
        self.log_seen = [np.log10(c).astype(np.float32) if len(c) else np.zeros(0, np.float32) for c in seen]
        self.whole, self.escape, self.past, self.passed = [], [], [], []
        total: list[np.ndarray] = []
        distinct: list[np.ndarray] = []
        for k in range(order + 1):
            above = self.grams[k] >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1]))) if len(above) else np.zeros(0, np.int64)
            self.contexts[k] = above[first]
            n = np.add.reduceat(seen[k], first).astype(np.float64) if len(above) else np.zeros(0)
            d = np.diff(np.concatenate((first, [len(above)]))).astype(np.float64)
            total.append(n)
            distinct.append(d)
            self.whole.append(np.log10(n + d).astype(np.float32))
            self.escape.append((np.log10(d) - np.log10(n + d)).astype(np.float32))
            if k and len(above):
                inside = np.searchsorted(self.grams[k - 1], self.grams[k] & _mask(k))
                excluded = np.add.reduceat(seen[k - 1][inside], first)
                up = np.searchsorted(self.contexts[k - 1], self.contexts[k] & _mask(k - 1))
                rest, kinds = total[k - 1][up] - excluded, distinct[k - 1][up] - d
                some = kinds > 0
                past = np.log10(np.where(some, rest + kinds, 1))
                self.past.append(past.astype(np.float32))
                self.passed.append(np.where(some, np.log10(np.where(some, kinds, 1)) - past, 0).astype(np.float32))
            else:
                self.past.append(np.zeros(0, np.float32))
                self.passed.append(np.zeros(0, np.float32))
        self.alike = np.float32(-math.log10(max(1, SYMBOLS - (int(distinct[0][0]) if len(distinct[0]) else 0))))

    def _find(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of keys in a sorted table, -1 where absent."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context."""
        out = np.zeros(len(grams), np.float32)
        left = np.arange(len(grams))
        above = np.full(len(grams), -1)  # place of the context escaped from
        for k in range(self.order, -1, -1):
            g = grams[left] & _mask(k + 1)
            own, at = self._find(self.contexts[k], g >> np.uint64(8)), self._find(self.grams[k], g)
            seen, entered, known = at >= 0, above[left] >= 0, own >= 0
            escaped = entered & seen
            past = self.past[k + 1] if k < self.order else np.zeros(0, np.float32)
            passed = self.passed[k + 1] if k < self.order else np.zeros(0, np.float32)
            out[left[escaped]] += self.log_seen[k][at[escaped]] - past[above[left[escaped]]]
            fresh = ~entered & seen
            out[left[fresh]] += self.log_seen[k][at[fresh]] - self.whole[k][own[fresh]]
            again = entered & ~seen
            out[left[again]] += passed[above[left[again]]]
            first = ~entered & ~seen & known
            out[left[first]] += self.escape[k][own[first]]
            above[left] = np.where(known, own, -1)
            left = left[~seen]
        out[left] += self.alike
        return out


LISTED = "block int, gram boolean, key long, n long"


def _listed(order: int):
    """Distinct words (as hashes) and contexts with symbols of each block, and how often its training documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        words: dict[bytes, int] = {}
        grams: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        block = None

        def rows(gram: bool, keys: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 100_000):
                n = len(keys[at : at + 100_000])
                yield pa.record_batch([pa.array([block] * n, pa.int32()), pa.array([gram] * n), pa.array(keys[at : at + n].view(np.int64)), pa.array(numbers[at : at + n])], names=["block", "gram", "key", "n"])

        def put() -> Iterator[pa.RecordBatch]:
            yield from rows(False, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
            if grams:
                yield from rows(True, *_summed(grams, counts))

        for batch in batches:
            of, trains = batch["block"].to_numpy(), batch["trains"].to_numpy(zero_copy_only=False)
            for a, b in _stretches(of):
                if of[a] != block:
                    if block is not None:
                        yield from put()
                    words, grams, counts, block = {}, [], [], int(of[a])
                texts, own = as_bytes(batch["text"].slice(a, b - a)), trains[a:b].tolist()
                get = words.get
                for text, learns in zip(texts, own):
                    for w in words_of(text):
                        words[w] = get(w, 0) + learns
                for learns in (True, False):
                    for some in sliced([t for t, x in zip(texts, own) if x == learns]):
                        g, c = np.unique(windows(some, order)[0], return_counts=True)
                        grams.append(g)
                        counts.append(c.astype(np.int64) if learns else np.zeros(len(g), np.int64))
                        if len(grams) > 1 and sum(map(len, grams[1:])) > GATHERED:
                            g, c = _summed(grams, counts)
                            grams, counts = [g], [c]
        if block is not None:
            yield from put()
        words, grams, counts = {}, [], []
        trimmed()

    return run


def _priced(shared, order: int):
    """log10 probability of each context with symbol, from classes that are whole: their rows follow each other.

    A class begins with the symbols that its last CLASS - 1 bytes had before them, and how often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        low = shared.value
        held: list[pa.RecordBatch] = []

        def put() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            first = rows.filter(rows["key"].is_null())
            rest = rows.filter(rows["key"].is_valid())
            ends = first["class"].to_numpy().astype(np.uint64) & _mask(CLASS - 1)
            ends, one = np.unique(ends, return_index=True)
            lists = first["low"].combine_chunks().take(pa.array(one))
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            pairs = lists.flatten()
            shorter = np.repeat(ends, sizes) << np.uint64(8) | pairs.field("s").to_numpy().astype(np.uint64)
            longest = _summed([shorter], [pairs.field("n").to_numpy()])
            keys, n = rest["key"].to_numpy().view(np.uint64), rest["n"].to_numpy()
            at = np.argsort(keys, kind="stable")
            keys, n = keys[at], n[at]
            trie = Trie(keys[n > 0], n[n > 0], [*low, longest], order)
            for at in range(0, len(keys), 100_000):
                some = keys[at : at + 100_000]
                yield pa.record_batch([pa.array(some.view(np.int64)), pa.array(trie.logs(some), pa.float32())], names=["key", "log"])

        size = 0
        for batch in batches:
            of = batch["class"].to_numpy()
            for a, b in _stretches(of):
                if size >= GRAMS and of[a] != held[-1]["class"][-1].as_py():
                    yield from put()
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += b - a
        if held:
            yield from put()
            held = []
        trimmed()

    return run


def _prices(grams: DataFrame, order: int) -> DataFrame:
    """(key, log): the log10 probability of every context with symbol in grams (key, n), by the n of all of them.

    Contexts are dealt by their latest three bytes, which is all that a context of three bytes or more can share with
    others; so a class has at most 2 ** 24 rows, however large the corpus is. With each go the counts after its latest two
    bytes, at most 256. Those after one byte, at most 65,536, and after none are broadcast.
    """
    spark = grams.sparkSession

    def low(k: int) -> DataFrame:
        return grams.where("n > 0").groupBy(F.expr(f"key & {(1 << 8 * (k + 1)) - 1}").alias("key")).agg(F.sum("n").alias("n"))

    two = written(low(CLASS - 1), "low")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(CLASS - 1):  # at most 256 and 65,536 rows
        rows = two.groupBy(F.expr(f"key & {(1 << 8 * (k + 1)) - 1}").alias("key")).agg(F.sum("n").alias("n")).toArrow()
        found.append(_summed([rows["key"].to_numpy().view(np.uint64)], [rows["n"].to_numpy()]))
    end = F.expr(f"class & {(1 << 8 * (CLASS - 1)) - 1}")
    listed = two.groupBy(F.expr("shiftright(key, 8)").alias("end")).agg(F.collect_list(F.struct(F.expr("key & 255").alias("s"), "n")).alias("low"))  # at most 256 each
    classed = grams.withColumn("class", F.expr(f"shiftrightunsigned(key, 8) & {(1 << 8 * CLASS) - 1}"))
    classes = classed.select("class").distinct().withColumn("end", end).join(listed, "end", "left")
    nothing = F.array().cast("array<struct<s: bigint, n: bigint>>")
    heads = classes.select("class", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("n"), F.coalesce("low", nothing).alias("low"))
    rows = classed.select("class", "key", "n", F.lit(None).cast("array<struct<s: bigint, n: bigint>>").alias("low"))
    dealt = heads.unionByName(rows).repartition("class").sortWithinPartitions("class")
    return dealt.mapInArrow(_priced(spark.sparkContext.broadcast(found), order), "key long, log float")


BASED = "doc_id long, n_tokens long, n_known long, base_sum double, score double"


def _based(ends: int, order: int):
    """Sums over each document's tokens and symbols, from what its block lists, which comes before the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        lists: dict[int, tuple[list, list]] = {}
        block = hashes = None

        class Places(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = at = int(np.searchsorted(hashes, np.uint64(xxhash.xxh3_64_intdigest(word))))
                return at

        def sorted_list(kind: int, values: type) -> tuple[np.ndarray, np.ndarray]:
            keys, found = lists.pop(kind)
            keys, found = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, values), *found])
            at = np.argsort(keys)
            return keys[at], found[at]

        end_log = math.log10(ends + 0.5)
        for batch in batches:
            of = batch["block"].to_numpy().astype(np.int64) << 2 | batch["kind"].to_numpy()
            for a, b in _stretches(of):
                part, kind = batch.slice(a, b - a), int(of[a]) & 3
                if int(of[a]) >> 2 != block:
                    block, lists, hashes = int(of[a]) >> 2, {WORD: ([], []), GRAM: ([], [])}, None
                if kind != DOC:
                    keys, found = lists[kind]
                    keys.append(part["key"].to_numpy().view(np.uint64))
                    found.append(part["n" if kind == WORD else "log"].to_numpy())
                    continue
                if hashes is None:
                    hashes, numbers = sorted_list(WORD, np.int64)
                    grams, prices = sorted_list(GRAM, np.float32)
                    logs, known = np.log10(numbers + 0.5), Places()
                texts, rows = as_bytes(part["text"]), []
                for text in texts:
                    found = words_of(text)
                    at = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
                    rows.append((len(found) + 1, int(np.count_nonzero(numbers[at])) + (ends > 0), float(logs[at].sum()) + end_log))
                scores = []
                for some in sliced(texts):
                    symbols, begins = windows(some, order)
                    different, back = np.unique(symbols, return_inverse=True)
                    scores.append(np.add.reduceat(prices[np.searchsorted(grams, different)][back], begins, dtype=np.float64))
                columns = [part["doc_id"], *[pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], pa.array(np.concatenate(scores))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in BASED.split(", ")])
        lists = hashes = numbers = grams = prices = logs = known = None
        trimmed()

    return run


#: Kinds of a block's rows, in the order in which they come.
WORD, GRAM, DOC = 0, 1, 2


def _stretches(of: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its doc_id as text, mod 5, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, trains: Column, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text, ...).

    The model learns from the rows for which `trains` holds. score is the log10 probability of a whole text by prediction
    by partial matching: its symbols are the bytes of its words, A-Z lower-cased, single spaces between them and an end;
    contexts have up to `order` (over 3) bytes. base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over its words and one
    end: c is a token's count, N that of all, V of distinct ones, in training rows. n_known counts tokens with c > 0.

    Documents are dealt to blocks of about 64 MB by hash. Each block lists its distinct words and contexts with symbols
    once, with its training documents' counts. From the sums over all blocks the probabilities are worked
    out once (_prices()); they and the word counts go back to the blocks, and there to the documents. So the model is never
    in one place, and a block holds what its own texts need. 64-bit hashes stand for words.

    Null and empty texts are an end alone. Without training rows all symbols are alike. Rows are scored one by one,
    repeated or not; an empty table gives no rows. Other columns of docs are ignored.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    total, ends = given.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.sum(F.col("trains").cast("long"))).first()
    blocks, ends = max(1, math.ceil((total or 0) / BLOCK_BYTES)), ends or 0
    block = F.pmod(F.xxhash64(F.lit("block"), "doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))), F.lit(blocks)).cast("int")
    tasks = min(blocks, TASKS)
    task = F.floor(F.col("block").cast("long") * tasks / blocks).cast("int")
    dealt = given.select(block.alias("block"), "text", "trains").repartitionById(tasks, task).sortWithinPartitions("block")
    listed = written(dealt.mapInArrow(_listed(order), LISTED), "listed")
    sums = listed.groupBy("gram", "key").agg(F.sum("n").alias("n"))
    sums = written(sums, "sums")
    counts, grams = sums.where("not gram").select("key", "n"), sums.where("gram").select("key", "n")
    size = counts.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long"))).first()
    tokens, distinct = (size[0] or 0) + ends, (size[1] or 0) + (ends > 0)

    # a key has at most as many rows as there are blocks, so none is hot
    empty = {"key": "long", "n": "long", "log": "float", "doc_id": "long", "text": "string"}

    def rows(df: DataFrame, kind: int) -> DataFrame:
        return df.select("block", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in empty.items()])

    words = listed.where("not gram").select("block", "key").join(counts, "key")
    symbols = listed.where("gram").select("block", "key").join(_prices(grams, order), "key")
    every = rows(words, WORD).unionByName(rows(symbols, GRAM)).unionByName(rows(given.select(block.alias("block"), "doc_id", "text"), DOC))
    out = every.repartitionById(tasks, task).sortWithinPartitions("block", "kind").mapInArrow(_based(ends, order), BASED)
    less = math.log10(tokens + 0.5 * (distinct + 1))
    base = F.col("base_sum") - F.col("n_tokens") * F.lit(less)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def digest(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """score() of every document, learned from those that aren't held out; a null doc_id is a training document."""
    out = score(docs, ~held_out(), order)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
