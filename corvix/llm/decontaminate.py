"""Benchmark decontamination: documents stream through a generalised suffix automaton of the test items."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import each_text, released, trimmed, written

WINDOW = 13
#: Words of test items in one automaton; more items make more automata, passed one after another.
AUTOMATON_WORDS = 100_000
#: Passes of one job, whose automata the workers of an executor hold at once.
PASSES = 3
PAIR_BITS = 23

#: Digits, a-z and all bytes from 0x80 make words; A-Z are lower-cased; the rest separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words: runs of digits, letters and non-ASCII bytes, A-Z lower-cased."""
    return text.translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word ids of items, with what windows end where.

    A window is `window` consecutive words of an item, or a whole item that has fewer. `items` has, for
    the state of each full window, the items it occurs in; `ends` has, for each state, the shorter whole
    items that are suffixes of its words, as (length, item).
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], {}
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                coded.append((name, ids))
        self.base = max(1, len(self.vocabulary))
        self.out: list[list[int]] = [[]]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        del self.out
        self.least = min([min(window, len(ids)) for _, ids in coded], default=window)
        self.items: dict[int, set[str]] = {}
        own: dict[int, list[tuple[int, str]]] = {}
        pairs = np.zeros(1 << PAIR_BITS, bool)
        for name, ids in coded:
            a = np.array(ids, np.int64)
            pairs[self.pair(a[:-1], a[1:])] = True
            state = 0
            for i, c in enumerate(ids):
                state = self.next[state * self.base + c]
                if i + 1 >= window:
                    state = self.cut(state)
                    self.items.setdefault(state, set()).add(name)
            if len(ids) < window:
                own.setdefault(state, []).append((len(ids), name))
        self.pairs = pairs
        self.ends: dict[int, list[tuple[int, str]]] = {}
        if own:
            for state in sorted(range(len(self.length)), key=self.length.__getitem__):
                found = self.ends.get(self.link[state], []) + own.get(state, [])
                if found:
                    self.ends[state] = found

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of neighbouring words in a table of pairs that occur; different pairs may share one."""
        return (a * 0x9E3779B1 + b * 0x85EBCA77) >> 7 & ((1 << PAIR_BITS) - 1)

    def _new(self, length: int, link: int, out: list[int], of: int | None = None) -> int:
        at = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self.out.append(list(out))
        if of is not None:
            for c in out:
                self.next[at * self.base + c] = self.next[of * self.base + c]
        return at

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q that holds only the words that p leads to by c."""
        clone = self._new(self.length[p] + 1, self.link[q], self.out[q], q)
        self.link[q] = clone
        while p != -1 and self.next.get(p * self.base + c) == q:
            self.next[p * self.base + c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        base = self.base
        q = self.next.get(last * base + c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._new(self.length[last] + 1, 0, [])
        p = last
        while p != -1 and (q := self.next.get(p * base + c)) is None:
            self.next[p * base + c] = new
            self.out[p].append(c)
            p = self.link[p]
        if p != -1:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def cut(self, state: int) -> int:
        """The state of the last `window` words of a state's words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str], int]:
        """Which words are inside an occurrence of a window (None: no word), the items, and the longest match."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        if not known.any():
            return None, set(), 0
        joint = known[1:] & known[:-1]
        joint &= self.pairs[self.pair(np.where(known[:-1], ids[:-1], 0), np.where(known[1:], ids[1:], 0))]
        # runs of words that are neighbours in some item; a window can stand in no other place
        edges = np.flatnonzero(np.concatenate(([True], ~joint, [True])))
        hit, items, longest = None, set(), 0
        for k in np.flatnonzero(np.diff(edges) >= self.least):
            start, stop = int(edges[k]), int(edges[k + 1])
            state = size = 0
            for i, c in enumerate(ids[start:stop].tolist(), start):
                while (to := self.next.get(state * self.base + c)) is None and state:
                    state = self.link[state]
                    size = self.length[state]
                if to is None or c < 0:
                    state = size = 0
                    continue
                state, size = to, size + 1
                longest = max(longest, size)
                covered = 0
                if size >= self.window:
                    covered = self.window
                    items |= self.items[self.cut(state)]
                for n, name in self.ends.get(state, ()):
                    if n <= size:
                        covered = max(covered, n)
                        items.add(name)
                if covered:
                    if hit is None:
                        hit = np.zeros(len(words), bool)
                    hit[i - covered + 1 : i + 1] = True
        return hit, items, longest


FOUND = T.StructType([T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()), T.StructField("words", T.LongType()), T.StructField("rest", T.StringType())])


def without(text: bytes, hits: np.ndarray) -> bytes:
    """A text without its runs of hit words, each from its first word's first byte to its last word's last."""
    spans = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hits, [0]))))
    out, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, text[at:]])


def _pass(shared, cut: bool):
    """What one automaton finds in texts, added to what others have: packed bits of hit words, items, the longest match.

    `rest` is, with `cut`, the text without its hit words, for texts that have some.
    """

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        released()
        automaton = shared.value
        for columns in batches:
            given, *others = columns if isinstance(columns, tuple) else [columns]
            found: list[tuple] = []
            before = zip(*(a.to_pylist() for a in others)) if others else [(None, None, 0)] * len(given)
            for text, (had, names, most) in zip(each_text(given), before):
                words = words_of(text)
                hit, items, size = automaton.match(words)
                if had:
                    old = np.unpackbits(np.frombuffer(had, np.uint8), count=len(words)).astype(bool)
                    hit = old if hit is None else hit | old
                rest = without(text, hit).decode() if cut and hit is not None else None
                found.append((None if hit is None else np.packbits(hit).tobytes(), sorted(items.union(names or ())), max(size, most), len(words), rest))
            kinds = [pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 5, kinds)], names=FOUND.names)
        trimmed()

    return F.arrow_udf(run, FOUND).asNondeterministic()  # else it may run once for each use


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cut: bool = False) -> DataFrame:
    """docs with _hits (bits of hit words, null: none), _items, _longest, _words and, with `cut`, _rest (see _pass()).

    Items are dealt by hash to as many automata as keep each under AUTOMATON_WORDS; the driver builds
    one at a time, and documents pass through one after another: once for each 100,000 words of items, which
    suits test sets of some million words, not a second corpus. Workers get texts and return findings only.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    parts = max(1, math.ceil(words / AUTOMATON_WORDS))
    out = docs
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        automaton = SuffixAutomaton(sorted((r.item_id, words_of(r.text.encode())) for r in part.collect()), window)
        given = [F.col("text").cast("string"), *([] if k == 0 else ["_hits", "_items", "_longest"])]
        found = out.withColumn("_found", _pass(spark.sparkContext.broadcast(automaton), cut and k + 1 == parts)(*given))
        out = found.select(*[F.col(f"`{n}`") for n in docs.columns], *[F.col(f"_found.{n}").alias(f"_{n}") for n in FOUND.names])
        if (k + 1) % PASSES == 0 and k + 1 < parts:
            out = written(out, "hits")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = 20) -> DataFrame:
    """docs with n_words, n_hit, items (ids as strings, sorted), longest and contaminated.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. A window is
    `window` consecutive words of an item, or all words of a shorter one. A document's word is hit if
    it stands inside an occurrence of a window. contaminated: n_hit > 0 and coverage * n_hit >= n_words.

    A null text has no words, nor has a null item; an item without words has no window. Items that
    share an id count once; a null id reads "null". Rows are handled one by one, repeated or not. An empty
    table of documents gives no rows, one of items no hits. Columns of docs with the names above, or
    with those of matches(), are replaced.
    """
    taken = ["n_words", "n_hit", "items", "longest", "contaminated", *[f"_{n}" for n in FOUND.names]]
    return _counted(matches(docs.drop(*taken), benchmark, window), coverage).drop("_rest")


def _counted(found: DataFrame, coverage: int) -> DataFrame:
    """Counts the set bits of _hits: digits of its hexadecimal form, by how many bits each has."""
    digits = F.hex("_hits")
    by_bits = {1: "1248", 2: "3569AC", 3: "7BDE", 4: "F"}
    total = None
    for bits, those in by_bits.items():
        n = F.length(F.translate(digits, "".join(c for c in "0123456789ABCDEF" if c not in those), "")) * bits
        total = n if total is None else total + n
    out = found.withColumn("n_hit", F.coalesce(total, F.lit(0)).cast("long")).withColumnsRenamed({"_words": "n_words", "_items": "items", "_longest": "longest"})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))).drop("_hits")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = 20) -> DataFrame:
    """docs without contaminated documents (see contamination()), and without the hit spans in the others' texts.

    A span is a run of hit words; it goes from its first word's first byte to its last word's last. Null
    texts and texts without hits stay as they are. Rows are handled one by one, repeated or not; all columns of docs
    come back, whatever their names, with `text` as a string. An empty table of documents gives no rows, one of items leaves all as it is.
    """

    names = [f"`{n}`" for n in docs.columns]
    whole = docs.select(F.col("text").cast("string").alias("text"), F.struct(*names).alias("_doc"))
    clean = _counted(matches(whole, benchmark, window, cut=True), coverage).where(~F.col("contaminated"))
    text = F.coalesce("_rest", "text").alias("text")
    return clean.select(*[text if n == "text" else F.col(f"_doc.`{n}`").alias(n) for n in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts, a hash of its items' ids, and the verdict."""
    out = contamination(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = """
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, item_id, n, s FROM grams JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN named ON dw.doc_id = named.doc_id
"""
