"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import dropped, each_text, least_hashed, local_table, released, trimmed, written

#: Labelled rows of each class that the model is fitted on at most, those with the smallest hashes.
SAMPLE = 3000
FOLDS = 3
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
MEMO = 300_000
#: Words whose hashes the driver keeps during a fit.
WORDS_KEPT = 50_000
#: Toxic documents, each group of near copies as one, for one that an entry adds at least.
RARE = 150
#: Hashes of a signature, and how many of them two near copies share at least: edits cost three runs of words each.
HASHES, SHARED = 64, 24
#: Words of a text that can be a near copy, at least: shorter ones share most of their runs by a stock phrase alone.
COPIED = 10
#: Lengths of stems.
STEMS = range(4, 9)
#: Words from each end of which a mention of the reader counts as near.
NEAR = 5

# Second-person pronouns of English, French, German and Spanish.
SECOND_PERSON = {
    "you", "your", "yours", "yourself", "u", "ur",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer",
    "tú", "ti", "tus", "usted", "ustedes", "vosotros", "vuestro",
}
# What characters in words stand for when they hide a letter.
HIDDEN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})

EDGES = "\"'`.,;:!?()[]{}<>|«»„“”…-"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHA = UPPER + UPPER.lower() + bytes(range(0xC3, 0xF5))

EXACT, STEM, READER, CAPITALS, HIDES = 1, 2, 4, 8, 16
FEATURES = ["log_words", "exact_rate", "stem_rate", "log_exact", "log_stem", "near_reader", "reader_rate", "upper_share", "capital_words", "exclaims", "questions", "punctuation", "hiding_words", "distinct_hits"]


def plain(word: str) -> str:
    return word.strip(EDGES).lower()


def entries(word: str) -> set[str]:
    """What a lexicon may list a word by: itself, and its beginnings of 4 to 8 letters, marked by *."""
    out = {word}
    out.update(f"{word[:n]}*" for n in STEMS if len(word) > n)
    return out


def _code(entry: str) -> int:
    return xxhash.xxh3_64_intdigest(entry)


def _listed(raw: str) -> set[str]:
    """What a word as it stands in texts may be listed by."""
    word = plain(raw)
    return entries(word) if len(word) >= 3 and any(c.isalpha() for c in word) else set()


class _Coded(dict):
    """64-bit hashes of what words may be listed by, kept while there are few words."""

    def __missing__(self, raw: str) -> tuple[int, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[raw] = out = tuple(map(_code, _listed(raw)))
        return out


class Reading:
    """What lexicons need to know of a fit's texts. Its lexicons share texts, so each is read once."""

    def __init__(self) -> None:
        self.words = _Coded()
        self._codes: dict[str, np.ndarray] = {}
        self._signed: dict[str, np.ndarray] = {}

    def codes(self, text: str) -> np.ndarray:
        """Hashes of what a text's words may be listed by, sorted, each once."""
        if text not in self._codes:
            found: set[int] = set()
            for raw in set(text.split()):
                found.update(self.words[raw])
            out = np.fromiter(found, np.uint64, len(found))
            out.sort()
            self._codes[text] = out
        return self._codes[text]

    def listed(self, texts: list[str], fits: set[int]) -> list[str]:
        """What the texts' words may be listed by, of those whose hashes are in `fits`."""
        out: set[str] = set()
        for raw in {w for t in texts for w in t.split()}:
            if not fits.isdisjoint(self.words[raw]):
                out.update(e for e in _listed(raw) if _code(e) in fits)
        return sorted(out)

    def signature(self, text: str) -> np.ndarray:
        if text not in self._signed:
            self._signed[text] = _signature([plain(w) for w in text.split()])
        return self._signed[text]


_TIMES = np.random.default_rng(1).integers(1, 2**63, (2, HASHES), np.uint64) | np.uint64(1)


def _signature(words: list[str], size: int = 4096) -> np.ndarray:
    """The least hashes of a text's runs of three words."""
    x = np.fromiter(map(_code, words), np.uint64, len(words))
    x = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
    x = np.unique(x ^ (x >> np.uint64(31)))
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    for at in range(0, len(x), size):
        np.minimum(out, ((x[at : at + size, None] * _TIMES[0] + _TIMES[1]) >> np.uint64(32)).min(0), out=out)
    return out.astype(np.uint32)


def copies(texts: list[str], read: Reading | None = None) -> list[int]:
    """The group of each text: those linked by three eighths of their runs of three words or more, by signature, are one."""
    read, parent = read or Reading(), list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    long = [i for i, t in enumerate(texts) if len(t.split()) >= COPIED]
    signed = np.array([read.signature(texts[i]) for i in long], np.uint32).reshape(-1, HASHES)
    for k, i in enumerate(long):
        for other in np.flatnonzero(np.count_nonzero(signed[k + 1 :] == signed[k], 1) >= SHARED).tolist():
            parent[root(long[k + 1 + other])] = root(i)
    numbers: dict[int, int] = {}
    return [numbers.setdefault(root(i), len(numbers)) for i in range(len(texts))]


class Lexicon:
    """Words and stems that mark toxic documents, learned by greedy cover.

    Toxic documents count once for each group of near copies. Entries are taken by how many of these, not
    yet covered three times, they add; they must be in at least three and be 50 times as frequent among
    toxic documents as among others. Thus words that only tell one group of copies apart are not taken,
    while those that always stand in the same phrase are.
    """

    def __init__(self, texts: list[str], labels: np.ndarray, read: Reading | None = None, covers: int = 3, least: int = 3, most: int = 400) -> None:
        self.entries: set[str] = set()
        read = read or Reading()
        bad = list(dict.fromkeys(t for t, label in zip(texts, labels) if label))
        if not bad:
            return
        groups: list[list[str]] = []
        for text, group in zip(bad, copies(bad, read)):
            if group == len(groups):
                groups.append([])
            groups[group].append(text)
        held = [np.unique(np.concatenate([read.codes(t) for t in group])) for group in groups]
        least = max(least, len(groups) // RARE)
        codes, n_bad = np.unique(np.concatenate(held), return_counts=True)
        codes, n_bad = codes[n_bad >= least], n_bad[n_bad >= least]
        if not len(codes):
            return
        n_good = np.zeros(len(codes), np.int64)
        for text in dict.fromkeys(t for t, label in zip(texts, labels) if not label):
            own = read.codes(text)
            own = own[own <= codes[-1]]
            at = np.searchsorted(codes, own)
            n_good[at[codes[at] == own]] += 1
        all_good = max(1, sum(1 for label in labels if not label))
        fits = set(codes[n_bad / len(groups) >= 50 * n_good / all_good].tolist())
        where: dict[str, list[int]] = {}
        of: list[list[str]] = []
        for i, group in enumerate(groups):
            of.append([] if fits.isdisjoint(held[i].tolist()) else read.listed(group, fits))
            for e in of[i]:
                where.setdefault(e, []).append(i)
        cover = [0] * len(groups)
        starts: list[str] = []
        gain = {e: len(docs) for e, docs in where.items()}
        while gain and len(self.entries) < most:
            e = max(gain, key=lambda e: (gain[e] * (9 if e[-1] == "*" else 10), len(e), e))
            if gain[e] < least:
                break
            del gain[e]
            start = e.rstrip("*")
            if any(start.startswith(x) or x.startswith(start) for x in starts):
                continue
            self.entries.add(e)
            starts.append(start)
            for i in where[e]:
                cover[i] += 1
                if cover[i] == covers:
                    for other in of[i]:
                        if other in gain:
                            gain[other] -= 1

    def flag(self, word: str) -> int:
        out = READER if word in SECOND_PERSON else 0
        if word in self.entries:
            return out | EXACT
        for n in STEMS:
            if len(word) > n and f"{word[:n]}*" in self.entries:
                return out | STEM
        return out


class _Flags(dict):
    """Flags of words as they stand in texts."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        word = plain(raw)
        out = self.lexicon.flag(word)
        if not word.isalpha() and any(c.isalpha() for c in word):
            shown = word.translate(HIDDEN)
            if shown != word:
                out |= HIDES | self.lexicon.flag(shown)
        if len(word) > 2 and raw.strip(EDGES).isupper():
            out |= CAPITALS
        self[raw] = out
        return out


def features(text: bytes | None, flags: _Flags) -> list[float]:
    """The dense features of a whole text; all zero for null and empty ones."""
    if not text:
        return [0.0] * len(FEATURES)
    words = text.decode("utf-8", "replace").split()
    if not words:
        return [0.0] * len(FEATURES)
    f = np.fromiter(map(flags.__getitem__, words), np.uint8, len(words))
    n = len(words)
    exact, stem = int(np.count_nonzero(f & EXACT)), int(np.count_nonzero(f & STEM))
    hits, readers = np.flatnonzero(f & (EXACT | STEM)), np.flatnonzero(f & READER)
    near = 0.0
    if len(hits) and len(readers):
        at = np.searchsorted(readers, hits)
        gap = np.minimum(np.abs(hits - readers[np.minimum(at, len(readers) - 1)]), np.abs(hits - readers[np.maximum(at - 1, 0)]))
        near = float(np.count_nonzero(gap <= NEAR)) / len(hits)
    letters = len(text) - len(text.translate(None, ALPHA)) or 1
    upper = len(text) - len(text.translate(None, UPPER))
    marks = sum(text.count(c) for c in (b".", b",", b";", b":", b"!", b"?"))
    return [
        math.log1p(n), exact / n, stem / n, math.log1p(exact), math.log1p(stem), near, len(readers) / n, upper / letters,
        np.count_nonzero(f & CAPITALS) / n, text.count(b"!") / n, text.count(b"?") / n, marks / n, np.count_nonzero(f & HIDES) / n,
        float(len({plain(words[i]) for i in hits.tolist()})),
    ]


class Boosted:
    """Gradient-boosted trees of fixed depth for log loss, on features cut at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(mean / (1 - mean))
        score = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grown(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._leaves(binned, tree)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def _grown(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS)
        node = np.zeros(len(g), int)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            best = np.full(width, 1e-9)
            for k in range(binned.shape[1]):
                at = (node - first) * BINS + binned[:, k]
                gs = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best = np.where(better, gain[np.arange(width), top], best)
                feature[first : first + width][better], cut[first : first + width][better] = k, top[better]
            node = 2 * node + 1 + (binned[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        gs, hs = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        return feature, cut, -RATE * gs / (hs + ridge)

    @staticmethod
    def _leaves(binned: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(binned), int), np.arange(len(binned))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - (2**DEPTH - 1)]

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self._leaves(binned, tree)
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing least-squares fit of y on x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, (blocks[-1][2] * blocks[-1][1] + c * n) / (blocks[-1][1] + n)]
    return np.array([c for _, _, c in blocks]), np.array([s / n for s, n, _ in blocks])


class Model:
    """Lexicon, trees and calibration, fitted on (text, label) rows.

    Each third of the rows gets its features from a lexicon of the other two, and its margins from
    trees of the other two, for the calibration; so neither has seen what it judges.
    """

    def __init__(self, rows: list[tuple[str, int]]) -> None:
        y = np.array([b for _, b in rows], float)
        self.constant = None
        if len(set(y.tolist())) < 2 or min(y.sum(), len(y) - y.sum()) < FOLDS:
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        texts = [a for a, _ in rows]
        fold = np.zeros(len(y), int)
        for label in (0, 1):  # copies stay in one fold
            names = {t: i % FOLDS for i, t in enumerate(dict.fromkeys(t for t, b in rows if b == label))}
            for i, (t, b) in enumerate(rows):
                if b == label:
                    fold[i] = names[t]
        x, read = np.zeros((len(y), len(FEATURES))), Reading()
        for k in range(FOLDS):
            rest = np.flatnonzero(fold != k)
            flags = _Flags(Lexicon([texts[i] for i in rest], y[rest], read))
            for i in np.flatnonzero(fold == k):
                x[i] = features(texts[i].encode(), flags)
        margins = np.zeros(len(y))
        for k in range(FOLDS):
            margins[fold == k] = Boosted(x[fold != k], y[fold != k]).margins(x[fold == k])
        self.points = isotonic(margins, y)
        self.trees = Boosted(x, y)
        self.lexicon = Lexicon(texts, y, read)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margins(x), *self.points), 0.0, 1.0)


def held_out() -> "F.Column":
    """Whether a document is kept from training: crc32 of its doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most `sample` labelled documents of each class, with the smallest hashes of doc_id.

    Rows with a null doc_id, label or text, labels without a document, and held-out documents teach nothing and
    take no places. A document labelled twice is toxic if any label says so.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    read = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = written(known.where("label in (0, 1)").join(read.select("doc_id"), "doc_id", "left_semi"), "known")
    ids = least_hashed(known, "label", sample).select("doc_id", "label").collect()
    dropped(known)
    if not ids:
        return Model([])
    chosen = F.broadcast(local_table(spark, {"doc_id": pa.array([r.doc_id for r in ids], pa.int64()), "label": pa.array([r.label for r in ids], pa.int32())}))
    texts = read.join(chosen, "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return Model([(r.text, r.label) for r in sorted(one.collect(), key=lambda r: r.doc_id)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on).

    Whole texts are scored; null and empty ones, and those of white space, have all features zero.
    Without labels of both classes the score is the share of toxic ones, 0 without any. Rows are scored
    one by one, repeated or not; an empty table gives no rows. Columns named score or predicted are replaced.
    Workers get texts and return scores only; the other columns stay in the JVM.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        released()
        fitted = shared.value
        flags = _Flags(fitted.lexicon) if fitted.constant is None else None
        for texts in batches:
            if flags is None:
                found = np.full(len(texts), fitted.constant)
            else:
                found = fitted.scores(np.array([features(t, flags) for t in each_text(texts)]).reshape(-1, len(FEATURES)))
            yield pa.array(found, pa.float64())
        flags = None
        trimmed()

    scored = F.arrow_udf(run, T.DoubleType()).asNondeterministic()  # else it may run once for each use
    out = docs.withColumn("score", scored(F.col("text").cast("string")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
