"""Language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_bytes, dropped, least_hashed, local_table, written
from .toxicity import held_out

#: Labelled documents that the model is fitted on at most: in all, and of each language.
SAMPLE, PER_LANGUAGE = 2000, 400
#: Hashed features: byte trigrams, and single bytes after them.
GRAMS = 1 << 13
SIZE = GRAMS + 256
EPOCHS = 12
#: Bytes worked on at once.
SLICE = 1 << 22

# Families of languages by ISO 639-1 code; other codes are families of their own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "pl", "cs", "sk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "celtic": ["ga", "cy", "gd", "br"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "indo-iranian": ["hi", "bn", "ur", "fa", "mr", "ne", "pa", "gu"],
    "semitic": ["ar", "he", "mt", "am"],
    "austronesian": ["id", "ms", "tl", "jv"],
}

_LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    return next((k for k, those in FAMILIES.items() if lang.lower()[:2] in those and len(lang.split("-")[0].split("_")[0]) == 2), f"other {lang}")


def codes(data: np.ndarray) -> np.ndarray:
    """Places of the trigrams that start at each byte but the last two."""
    a = data.astype(np.uint32)
    return ((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)


#: Bytes that say nothing about a language.
_NO_LETTERS = b"0123456789()+|$%#*@=<>[]{}/\\_\"&~^"


def prepared(text: bytes) -> bytes:
    """Lower case, without digits and signs, with single spaces between words and one at both ends."""
    plain = text.decode("utf-8", "replace").lower().encode().translate(None, _NO_LETTERS)
    return b" ".join([b"", *plain.split(), b""])


def vector(text: bytes) -> np.ndarray:
    """Relative frequencies of a text's trigrams and bytes."""
    data = np.frombuffer(prepared(text), np.uint8)
    out = np.zeros(SIZE)
    if len(data) > 2:
        out[:GRAMS] = np.bincount(codes(data), minlength=GRAMS) / (len(data) - 2)
        out[GRAMS:] = np.bincount(data, minlength=256) / (len(data) - 2)
    return out


def svm(x: np.ndarray, y: np.ndarray, seed: int, c: float = 10.0) -> np.ndarray:
    """Weights of a linear support vector machine with bias, by dual coordinate descent; y is +1 or -1."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    norm = np.maximum((x * x).sum(1), 1e-12)
    alpha, w, random = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    weight = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(EPOCHS):
        for i in random.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def slope(margins: np.ndarray, y: np.ndarray) -> float:
    """The scale at which a logistic curve of the margins fits the labels best."""
    s = 1.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(s * margins * y, -30, 30)))
        g, h = ((1 - p) * margins * y).sum() - 0.01 * s, (p * (1 - p) * margins**2).sum() + 0.01
        s = min(max(s + g / h, 0.1), 20.0)
    return s


class Model:
    """Linear machines: one for each family against the rest, and one for each pair within a family."""

    def __init__(self, rows: list[tuple[bytes, str]]) -> None:
        self.langs = sorted({lang for _, lang in rows})
        groups: dict[str, list[str]] = {}
        for lang in self.langs:
            groups.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(groups.items())
        self.machines: list[tuple] = []
        if not rows:
            return
        x = np.array([vector(t) for t, _ in rows], np.float32)
        scale = 1 / (x.std(0) + 1e-4)
        self.mean = x.mean(0)
        x = (x - self.mean) * scale / math.sqrt(SIZE)
        family = np.array([family_of(lang) for _, lang in rows])
        lang = np.array([lang for _, lang in rows])
        weights, self.slopes = [], []
        if len(self.families) > 1:
            for k, (name, _) in enumerate(self.families):
                self._learn(("family", k), x, np.where(family == name, 1.0, -1.0), weights)
        for k, (_, those) in enumerate(self.families):
            for a, b in combinations(range(len(those)), 2):
                own = (lang == those[a]) | (lang == those[b])
                self._learn(("pair", k, a, b), x[own], np.where(lang[own] == those[a], 1.0, -1.0), weights)
        w = np.array(weights).reshape(-1, SIZE + 1)
        self.bias = w[:, -1] - (w[:, :-1] * scale * self.mean).sum(1) / math.sqrt(SIZE)
        w = w[:, :-1] * scale / math.sqrt(SIZE)
        self.grams, self.bytes = np.ascontiguousarray(w[:, :GRAMS]), np.ascontiguousarray(w[:, GRAMS:])

    def _learn(self, name: tuple, x: np.ndarray, y: np.ndarray, weights: list) -> None:
        w = svm(x.astype(np.float64), y, len(weights))
        self.machines.append(name)
        self.slopes.append(slope(x @ w[:-1] + w[-1], y))
        weights.append(w)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Margins of each text by each machine; texts go through in slices, whole."""
        out = np.zeros((len(texts), len(self.machines)))
        for i, text in enumerate(texts):
            data = np.frombuffer(prepared(text), np.uint8)
            n = max(1, len(data) - 2)
            counts = np.zeros(GRAMS)
            for at in range(0, len(data) - 2, SLICE):
                counts += np.bincount(codes(data[at : at + SLICE + 2]), minlength=GRAMS)
            out[i] = self.grams @ (counts / n) + self.bytes @ (np.bincount(data, minlength=256) / n) + self.bias
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        margins = self.margins(texts)
        p = 1 / (1 + np.exp(-np.clip(margins * np.array(self.slopes), -30, 30)))
        out = []
        at = {name: i for i, name in enumerate(self.machines)}
        for i in range(len(texts)):
            best, sure = 0, 1.0
            if len(self.families) > 1:
                shares = np.array([p[i, at["family", k]] for k in range(len(self.families))])
                best = int(shares.argmax())
                sure = float(shares[best] / shares.sum())
            those = self.families[best][1]
            votes, shares = np.zeros(len(those)), np.zeros(len(those))
            for a, b in combinations(range(len(those)), 2):
                q = p[i, at["pair", best, a, b]]
                votes[a if q >= 0.5 else b] += 1
                shares[a] += q
                shares[b] += 1 - q
            top = int(np.lexsort((shares, votes))[-1]) if len(those) > 1 else 0
            out.append((those[top], sure * (float(shares[top] / shares.sum()) if len(those) > 1 else 1.0)))
        return out


def fit(docs: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> Model:
    """A model of at most `sample` labelled documents, as many of each language, with the smallest hashes.

    Held-out documents and those with a null language, or a null or letterless text, teach nothing and
    take no places. Every language has two places at least, however many languages there are.
    """
    known = docs.where("doc_id is not null and lang is not null").where(~held_out())
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    able = written(known.where(F.col("text").rlike(r"\p{L}")).select("lang", "doc_id").distinct(), "able")
    first = written(least_hashed(able, "lang", per_language), "languages")
    each = max(2, sample // max(1, first.select("lang").distinct().count()))
    ids = [(r.doc_id, r.lang) for r in first.where(F.col("at") <= each).collect()]
    dropped(able, first)
    if not ids:
        return Model([])
    chosen = F.broadcast(local_table(docs.sparkSession, {"doc_id": pa.array([i for i, _ in ids], pa.int64()), "lang": pa.array([x for _, x in ids], pa.string())}))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("text").rlike(r"\p{L}")).join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sorted(texts.collect(), key=lambda r: (r.doc_id, r.lang))
    return Model([(r.text.encode(), r.lang) for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    Only the whole text counts. lang_pred is a language the model has learned, or "und" with score 0 if the
    text is null or has no letter, or nothing has been learned. Rows are judged one by one, repeated
    or not; an empty table gives no rows. Columns named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = as_bytes(batch["text"])
            found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
            able = [i for i, t in enumerate(texts) if t and fitted.langs and _LETTER.search(t.decode("utf-8", "replace"))]
            for i, x in zip(able, fitted.predict([texts[i] for i in able]) if able else []):
                found[i] = x
            columns = [*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def digest(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
