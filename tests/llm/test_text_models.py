"""Language identification, toxicity and decontamination."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvix.llm import _common, decontaminate, language, toxicity

VOCABULARY = {
    "en": "the of and to in that with which would through thing house water weather should think".split(),
    "de": "der die das und nicht mit über schön haus wasser wetter straße zwischen möchte große".split(),
    "fr": "le la les des avec être maison eau où garçon très beaucoup français même pour".split(),
    "es": "el los las una con niño casa agua dónde mañana señor también muy corazón para".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randrange(3, 40)), lang, "z") for i, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    odd = [(1000, None, "en", "z"), (1001, "", "en", "z"), (1002, "12 34 !", "de", "z"), (1003, "der die das " * 30000, None, "z"), (None, "les garçons avec", "fr", "z"), (1004, "日本", None, "z")]
    docs = spark.createDataFrame(rows + odd + rows[:2], "doc_id long, text string, lang string, lang_pred string")
    out = language.identify(docs, language.fit(docs)).collect()
    assert len(out) == len(rows) + len(odd) + 2
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert sum(got[i][0] == lang for i, _, lang, _ in rows) >= 0.97 * len(rows)
    assert [got[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003][0] == "de" and got[None][0] == "fr" and got[1004][0] in VOCABULARY
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    assert language.digest(docs.limit(0)).count() == 0
    only = docs.where("lang = 'en'")
    assert {r.lang_pred for r in language.identify(docs.where("doc_id < 20"), language.fit(only)).collect()} == {"en"}


def test_language_learns_from_training_only(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"))
    keep = docs.where(language.held_out())
    other = docs.where(~language.held_out())
    rng = random.Random(3)
    a = keep.select("doc_id", F.lit(text(rng, "fr", 9)).alias("text"), F.lit("fr").alias("lang"))
    b = other.select("doc_id", F.lit(text(rng, "de", 9)).alias("text"), F.lit("de").alias("lang"))
    assert language.fit(a.unionByName(b)).langs == ["de"]


def test_language_places_go_to_usable_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "Model", lambda rows: rows)
    rows = [(i, "les garçons" if i % 20 == 0 else [None, "", "12 !"][i % 3], "fr") for i in range(2000)]
    rows += [(i, "der die", "de") for i in range(2000, 2400)] * 3
    found = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100, 40)
    assert [sum(lang == x for _, lang in found) for x in ("fr", "de")] == [40, 40]
    many = spark.createDataFrame([(i, "text", f"l{i % 60}") for i in range(1200)], "doc_id long, text string, lang string")
    assert {lang for _, lang in language.fit(many, 100)} == {f"l{i}" for i in range(60)}


def test_toxicity_places_go_to_usable_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "Model", lambda rows: rows)
    docs = spark.createDataFrame([(i, "text" if i % 10 == 0 else None) for i in range(2000)], "doc_id long, text string")
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 20 == 0).cast("int").alias("toxic"))
    found = toxicity.fit(docs, labels.unionByName(labels), 50)
    assert [sum(label == x for _, label in found) for x in (0, 1)] == [50, 50]


def test_families():
    assert language.family_of("en") == language.family_of("de") != language.family_of("fr")
    assert language.family_of("pt-BR") == language.family_of("es")
    assert language.family_of("zz") == "other zz"


BAD = ["idiot", "moron", "scum"]


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        w = text(rng, rng.choice(["en", "de"]), rng.randrange(5, 60)).split()
        if i % 4 == 0:
            for _ in range(1 + len(w) // 12):
                w[rng.randrange(len(w))] = rng.choice([*BAD, "zwurb" + rng.choice("abcdefg") * 2])
        rows.append((i, " ".join(w), 0.5))
        labels.append((i, int(i % 4 == 0)))
    odd = [(2000, None, 0.1), (2001, "", 0.1), (2002, " \n", 0.1), (2003, "house " * 50000, 0.1), (2004, "you 1d10t water house the", 0.1), (None, "scum water", 0.1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score double")
    return docs, spark.createDataFrame([*labels, (None, 1), (2001, None), (0, 1)], "doc_id long, toxic int")


def test_toxicity(spark, toxic):
    docs, labels = toxic
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect() if r.doc_id < 900}
    assert len(held) > 100
    right = sum(out[i].predicted == int(i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert [out[i].predicted for i in (2000, 2001, 2002, 2003)] == [0] * 4
    assert out[2004].predicted == out[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in out.values())
    assert out[2000].score == out[2001].score == out[2002].score


def test_toxicity_without_labels(spark, toxic):
    docs, labels = toxic
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert toxicity.digest(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("phrase", [[], ["you", "are", "an"]])
def test_lexicon_keeps_common_insults(phrase):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(6000):
        w = text(rng, rng.choice(["en", "de"]), rng.randrange(5, 60)).split()
        if i % 2:
            at = rng.randrange(len(w))
            w[at : at + 1] = [*phrase, rng.choice(BAD)]
        elif i % 20 == 0:
            w[1:1] = ["you", "are", "an"]
        texts.append(" ".join(w))
        labels.append(i % 2)
    assert toxicity.Lexicon(texts, np.array(labels, float)).entries == set(BAD)


def test_lexicon_counts_near_copies_once():
    rng = random.Random(5)
    first = [f"{w}{k}" for k, w in enumerate(text(rng, "fr", 80).split())]
    near = [" ".join(rng.choice(VOCABULARY["fr"]) if rng.random() < 0.04 else w for w in first) for _ in range(200)]
    bad = [text(rng, "en", 30) + " " + rng.choice(BAD) for _ in range(200)]
    short = [f"you moron {w}" for w in VOCABULARY["es"]]
    good = [text(rng, rng.choice(["en", "fr", "es"]), 30) for _ in range(800)]
    assert len(set(toxicity.copies(near))) == 1
    assert len(set(toxicity.copies(bad + short))) == len(bad + short)
    found = toxicity.Lexicon(near + bad + short + good, np.array([1.0] * 216 + [1.0] * 200 + [0.0] * 800))
    assert set(BAD) <= found.entries <= {*BAD, "you"}


def test_isotonic():
    x, y = toxicity.isotonic(np.array([3.0, 1, 2, 4, 5, 5]), np.array([0.0, 0, 1, 1, 1, 1]))
    assert (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == 1 and 0.5 in y


def naive(docs, items, window=13):
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t or "").split(" ")
    cut = lambda t: [w for w in words(t) if w]
    found = {}
    for i, t in items:
        w = cut(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            found.setdefault(tuple(w[s : s + n]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w = cut(t)
        hit, names = [False] * len(w), set()
        for n in {len(g) for g in found}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in found:
                    names |= found[tuple(w[s : s + n])]
                    hit[s : s + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(names), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tests_and_docs():
    rng = random.Random(9)
    pool = [f"t{i}" for i in range(9)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 8, 12, 13, 14, 20, 40])))) for i in range(25)]
    items += [(7, "aa BB, cc-dd"), (7, "é ü 日本 x"), (None, "null item id words"), (80, ""), (81, None), (82, "..."), (83, "t1 " * 30)]
    docs = []
    for i in range(80):
        w = [rng.choice([*pool, "q", "z"]) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            t = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[rng.randrange(len(t) + 1) :] if t else []
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper()))
    return items, docs + [(200, None), (201, ""), (202, "?!"), (203, "q " * 60000 + "aa bb cc dd"), (None, "xx É ü 日本 x yy"), (5, "aa bb cc dd")]


@pytest.mark.parametrize("size", [100_000, 40])
def test_contamination(spark, tests_and_docs, monkeypatch, size):
    items, docs = tests_and_docs
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", size)
    d = spark.createDataFrame([(i, t, "z", 3) for i, t in docs], "doc_id long, text string, items string, n_hit int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(d, b)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in out.collect()), key=str)
    assert got == naive(docs, items)
    assert out.count() == len(docs)


def test_contamination_edges(spark, tests_and_docs):
    items, docs = tests_and_docs
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(d, b.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_remove_spans(spark):
    item = " ".join(f"i{k}" for k in range(20))
    filler = " ".join(f"f{k}" for k in range(600))
    d = spark.createDataFrame([(1, f"{filler}, {item.upper()}! {filler}"), (2, item), (3, "clean é"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.remove_spans(d, b).collect()}
    assert out == {1: f"{filler}, ! {filler}", 3: "clean é", 4: None}


def test_remove_spans_with_clashing_columns(spark):
    item = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"{'a ' * 600}{item.upper()}, b", "x", 9), (2, None, "y", 8), (2, None, "y", 8), (3, item, "z", 7)], "doc_id long, text string, _hits string, n_hit int")
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.remove_spans(docs, tests).collect()), key=str)
    assert got == [(1, f"{'a ' * 600}, b", "x", 9), (2, None, "y", 8), (2, None, "y", 8)]
    assert decontaminate.remove_spans(docs, tests.limit(0)).count() == 4
    assert decontaminate.remove_spans(docs.limit(0), tests).count() == 0


def naive_language(model, data):
    """A text's language and score by the fitted weights, one trigram and one vote at a time."""
    if not data or not any(c.isalpha() for c in data.decode()):
        return "und", 0.0
    plain = b" " + b" ".join(bytes(b for b in data.decode().lower().encode() if b not in language._NO_LETTERS).split()) + b" "
    n = max(1, len(plain) - 2)
    sure = {}
    for j, name in enumerate(model.machines):
        margin = model.bias[j] + sum(model.bytes[j][b] for b in plain) / n
        for i in range(len(plain) - 2):
            place = ((plain[i] << 16 | plain[i + 1] << 8 | plain[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 19
            margin += model.grams[j][place] / n
        sure[name] = 1 / (1 + np.exp(-max(-30, min(30, model.slopes[j] * margin))))
    shares = [sure["family", k] for k in range(len(model.families))]
    best = shares.index(max(shares))
    those = model.families[best][1]
    votes, sums = [0] * len(those), [0.0] * len(those)
    for a in range(len(those)):
        for b in range(a + 1, len(those)):
            q = sure["pair", best, a, b]
            votes[a if q >= 0.5 else b] += 1
            sums[a] += q
            sums[b] += 1 - q
    top = max(range(len(those)), key=lambda i: (votes[i], sums[i], i))
    return those[top], shares[best] / sum(shares) * (sums[top] / sum(sums) if len(those) > 1 else 1)


def test_language_by_votes(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, lang, rng.randrange(3, 30)), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 12)]
    docs = spark.createDataFrame([*rows, (90, "12", None), (91, None, None), (92, "Señor 3x DER die, haus!", None)] + rows[:2], "doc_id long, text string, lang string")
    model = language.fit(docs)
    for r in language.identify(docs, model).collect():
        lang, sure = naive_language(model, (r.text or "").encode())
        assert r.lang_pred == lang and r.score == pytest.approx(sure, abs=1e-5)


def naive_toxicity(model, data):
    """A text's score by the fitted lexicon, trees and calibration, word by word, tree by tree."""
    words = (data or "").split()
    x = [0.0] * len(toxicity.FEATURES)
    if words:
        plain = [w.strip(toxicity.EDGES).lower() for w in words]

        def kind(w):
            if w in model.lexicon.entries:
                return "exact"
            return "stem" if any(len(w) > n and f"{w[:n]}*" in model.lexicon.entries for n in toxicity.STEMS) else ""

        shown = [w if w.isalpha() or not any(c.isalpha() for c in w) else w.translate(toxicity.HIDDEN) for w in plain]
        kinds = [{kind(w), kind(s)} - {""} for w, s in zip(plain, shown)]
        readers = [i for i, (w, s) in enumerate(zip(plain, shown)) if {w, s} & toxicity.SECOND_PERSON]
        exact, stem = sum("exact" in k for k in kinds), sum("stem" in k for k in kinds)
        hits = [i for i, k in enumerate(kinds) if k]
        near = sum(any(abs(i - r) <= toxicity.NEAR for r in readers) for i in hits) / len(hits) if hits else 0.0
        raw = data.encode()
        letters = sum(b in toxicity.ALPHA for b in raw) or 1
        n = len(words)
        capitals = sum(len(w) > 2 and o.strip(toxicity.EDGES).isupper() for o, w in zip(words, plain))
        x = [np.log1p(n), exact / n, stem / n, np.log1p(exact), np.log1p(stem), near, len(readers) / n, sum(65 <= b <= 90 for b in raw) / letters, capitals / n]
        x += [data.count("!") / n, data.count("?") / n, sum(data.count(c) for c in ".,;:!?") / n, sum(s != w for s, w in zip(shown, plain)) / n, len({plain[i] for i in hits})]
    margin = model.trees.base
    for feature, cut, value in model.trees.trees:
        node = 0
        for _ in range(toxicity.DEPTH):
            k = feature[node]
            node = 2 * node + 1 + int(sum(c < x[k] for c in model.trees.cuts[k]) > cut[node])
        margin += value[node - (2**toxicity.DEPTH - 1)]
    xs, ys = model.points
    if margin <= xs[0]:
        return ys[0]
    for (a, p), (b, q) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        if a < margin <= b:
            return p + (q - p) * (margin - a) / (b - a)
    return ys[-1]


def test_toxicity_by_words(spark, toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    some = docs.where("doc_id is null or doc_id % 7 = 0 or doc_id in (2000, 2001, 2002, 2004)")
    for r in toxicity.score(some.union(some.limit(5)), model).collect():
        assert r.score == pytest.approx(min(1, max(0, naive_toxicity(model, r.text))), abs=1e-9)


def test_least_hashed(spark, tmp_path):
    spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "few").when(F.col("id") % 3 == 0, "some").otherwise("most").alias("g")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    hashed = rows.select("g", "doc_id", F.xxhash64(F.lit("sample"), "doc_id").alias("h")).collect()
    for most in (1, 50, 700):
        wanted = set()
        for g in ("few", "some", "most"):
            best = sorted((r.h, r.doc_id) for r in hashed if r.g == g)[:most]
            wanted |= {(g, i, n) for n, (_, i) in enumerate(best, 1)}
        found = _common.least_hashed(rows, "g", most)
        assert {(r.g, r.doc_id, r.at) for r in found.collect()} == wanted
    assert _common.least_hashed(rows.limit(0), "g", 5).count() == 0
