"""Tokens, packing, token files, sharding, scoring and exact search against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvix.llm import packing, ppm, sharding, vafile, wavelet
from corvix.llm import tokens as tokenizing
from corvix.llm.packing import Packer

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = "a B é 1 2 's ' s t . , ! _ - ß 日 ́ 😀 'll <|endoftext|> \r \x00 ² ª ١ *** $$ Ġ".split(" ") + [" ", " ", " ", "\n", "\t", " ", " "]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH) as f:
        return tokenizing.Encoder(f.read())


def whole(encoder, text, end=None):
    ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, *([] if end is None else [end])], "<u4").tobytes()


def test_encoder(encoder, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(1, 16))) for _ in range(4000)] + [None, "", " ", "\n", "a  b", "word " * 3000, "x" * 30_000, " lead", "trail "]
    assert list(encoder.encode(texts)) == [whole(encoder, t) for t in texts]
    monkeypatch.setattr(tokenizing, "KEPT", 50)
    monkeypatch.setattr(tokenizing, "SLICE", 100)
    assert list(encoder.encode(texts)) == [whole(encoder, t) for t in texts]


def test_encoder_keeps_a_word_once_whatever_marks_follow(encoder):
    with open(PATH) as f:
        own = tokenizing.Encoder(f.read())
    texts = ["alpha, alpha. alpha!\nalpha alpha?! alpha", "alpha. caf\u00e9, caf\u00e9; caf\u00e9"]
    assert list(own.encode(texts)) == [whole(encoder, t) for t in texts]
    assert sorted(own.known) == sorted(p.encode() for p in ["\nalpha", " alpha", " caf\u00e9", ",", ".", "!", "?!", ";"])


def test_encoder_cuts_at_no_other_white_space(encoder):
    odd = [" ", "\n", *"\t\r\x1c\x85\xa0\u1680\u180e\u2000\u200a\u200b\u2028\u202f\u205f\u3000\u00d7\u00f7\u00e9\u00df\u0100\u017f\u0180\u0120\u0301\u201d,.'!-_*b7", "'s", "'ll"]
    rng = random.Random(4)
    texts = ["".join(rng.choices(odd, k=rng.randrange(9))) for _ in range(20_000)] + [a + b + c for a in odd for b in " \n,'" for c in odd]
    want = [whole(encoder, t) for t in texts]
    assert list(encoder.encode(texts)) == want
    assert list(encoder.encode(pa.array([None, *texts]).slice(9))) == want[8:]
    assert list(encoder.encode([])) == [] and list(encoder.encode([None, None])) == [b"", b""]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "the an wor ld str ing".split() for b in ["", "er", "ing", "9", "!", ",", "é"]]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 200, 1500]))), "z") for i in range(90)]
    rows += [(500, None, "z"), (501, "", "z"), (None, "no id", "z"), (7, "same id", "z"), (7, "same id", "z"), (502, "long text " * 9000, "z")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4).cache()


def test_packing(spark, docs, encoder, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(packing, "GATHERED", 3000)
    out = packing.pack(df, PATH).collect()
    by_seq, total = collections.defaultdict(list), 0
    for r in out:
        by_seq[r.sequence_id].append(r)
        total += r.length
        assert len(r.ids) == 4 * r.length
    want = collections.Counter(whole(encoder, t, 1) for _, t, _ in rows)
    assert total == sum(len(k) // 4 * n for k, n in want.items())
    unique = {i: t for i, t, _ in rows if i != 7}
    for i, t in unique.items():
        parts = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        ids = whole(encoder, t, 1)
        assert b"".join(bytes(p.ids) for p in parts) == ids
        assert [p.start for p in parts] == np.cumsum([0, *[p.length for p in parts]])[:-1].tolist()
        assert all(p.doc_tokens == len(ids) // 4 for p in parts)
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        n = sum(p.length for p in parts)
        assert [p.offset for p in parts] == np.cumsum([0, *[p.length for p in parts]])[:-1].tolist()
        assert n == parts[0].context <= 2048 and n & (n - 1) == 0 and len({(p.context, p.step_group) for p in parts}) == 1
    groups = collections.Counter((p[0].context, p[0].step_group) for p in by_seq.values())
    for size in {k for k, _ in groups}:
        counts = [n for (k, _), n in sorted(groups.items()) if k == size]
        assert set(counts[:-1]) <= {packing.STEP // size} and counts[-1] <= packing.STEP // size
    assert packing.digest(df.limit(0), PATH).count() == 0
    assert packing.digest(df, PATH).agg(F.sum("length")).first()[0] == total
    clashing = df.withColumns({"part": F.lit("x"), "context": F.lit("y"), "sequence": F.lit(0)})
    assert packing.digest(clashing, PATH).agg(F.sum("length")).first()[0] == total


def naive_windows(lengths, tiers):
    """Packer's windows by lists: (size, [(document, first id, ids)])."""
    pieces, out = [], []
    for doc, n in enumerate(lengths):
        at = 0
        while n - at > tiers[0]:
            out.append((tiers[0], [(doc, at, tiers[0])]))
            at += tiers[0]
        if n > at:
            pieces.append((doc, at, n - at))

    def window(size):
        own, room = [], size
        while room:
            fits = [p for p in pieces if p[2] <= room]
            if fits:
                piece = next(p for p in fits if p[2] == max(q[2] for q in fits))
                pieces.remove(piece)
            else:
                least = min(p[2] for p in pieces)
                doc, at, n = next(p for p in pieces if p[2] == least)
                pieces.remove((doc, at, n))
                piece = (doc, at, room)
                pieces.append((doc, at + room, n - room))
            own.append(piece)
            room -= piece[2]
        return size, own

    for size, less in zip(tiers, (*tiers[1:], 0)):
        while sum(p[2] for p in pieces) >= size and any(less < p[2] <= size for p in pieces):
            out.append(window(size))
    size = tiers[0]
    while pieces:
        while sum(p[2] for p in pieces) >= size:
            out.append(window(size))
        size //= 2
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packer_by_lists(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 3, 20, 60, 100, 127, 128, 130, 500]) for _ in range(rng.choice([1, 7, 300]))]
    p, got = Packer((128, 64, 32)), []
    for d, n in enumerate(lengths):
        got += p.route(d, n)
    assert [*got, *p.finish()] == naive_windows(lengths, (128, 64, 32))


def test_packer_fills_windows():
    rng = random.Random(1)
    p, lengths = Packer(), []
    windows = []
    for d in range(4000):
        lengths.append(rng.choice([1, 3, 100, 255, 256, 700, 1500, 2048, 5000, rng.randrange(1, 2000)]))
        windows += p.route(d, lengths[-1])
        if d % 500 == 0:
            windows += p.pack()
    windows += p.finish()
    pieces = collections.Counter(d for _, w in windows for d, _, _ in w)
    assert all(sum(n for _, _, n in w) == size for size, w in windows)
    assert sum(n for _, w in windows for _, _, n in w) == sum(lengths)
    short = [d for d, n in enumerate(lengths) if n <= 2048]
    cut = [d for d in short if pieces[d] > 1]
    assert len(cut) <= len(windows) and len(cut) < 0.15 * len(short)
    assert {2048, 1024, 512, 256} <= {size for size, _ in windows}


def test_packing_needs_no_padding(spark, docs):
    rows, df = docs
    ids = {}
    for parts in (1, 30):
        out = packing.pack(df.repartition(parts), PATH).groupBy("sequence_id", "context").agg(F.sum("length").alias("n")).collect()
        assert all(r.n == r.context and r.n & (r.n - 1) == 0 for r in out)
        ids[parts] = sum(r.n for r in out)
    assert ids[1] == ids[30]
    p = Packer()
    windows = [*p.route(0, 255), *p.route(1, 300), *p.finish()]
    assert [(size, sum(n for _, _, n in w)) for size, w in windows] == [(512, 512), (32, 32), (8, 8), (2, 2), (1, 1)]


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_token_files(spark, docs, encoder, tmp_path, monkeypatch, block):
    rows, df = docs
    monkeypatch.setattr(wavelet, "BLOCK", block)
    wavelet.write_tokens(df, PATH, str(tmp_path / "t"))
    out = wavelet.read_tokens(spark, str(tmp_path / "t")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for want, got in zip(order, sorted(out, key=lambda r: r.start), strict=True):
        ids = whole(encoder, want[1], 2)
        assert (got.doc_id, got.start, got.n_tokens, bytes(got.ids), got.ids_crc32) == (want[0], start, len(ids) // 4, ids, zlib.crc32(ids))
        start += len(ids) // 4
    path = str(tmp_path / "t")
    every = np.concatenate([np.frombuffer(whole(encoder, t, 2), "<u4") for _, t, _ in order]).astype(int)
    places = [0, 1, 17, 49, 50, 51, len(every) // 2, len(every) - 1]
    assert sorted(map(tuple, wavelet.access(spark, path, [*places, -1, len(every), 10**12]).collect())) == [(p, every[p]) for p in sorted(set(places))]
    common = collections.Counter(every.tolist()).most_common()
    for token in (2, common[1][0], common[-1][0], 49_999, 70_000):
        at = np.flatnonzero(every == token)
        assert wavelet.count(spark, path, token) == len(at)
        assert wavelet.count(spark, path, token, 40, len(every) - 333) == np.count_nonzero((at >= 40) & (at < len(every) - 333))
        assert sorted(r.place for r in wavelet.positions(spark, path, token).collect()) == at.tolist()
    assert wavelet.digest(df.limit(0), PATH).count() == 0
    wavelet.write_tokens(df.limit(0), PATH, str(tmp_path / "none"))
    assert wavelet.count(spark, str(tmp_path / "none"), 2) == 0 and wavelet.access(spark, str(tmp_path / "none"), [0]).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for x in (rng.zipf(1.3, 9000) % 60000, rng.zipf(1.1, 150_000) % 50_000, np.zeros(5, int), np.array([70000, 1, 70000]), np.zeros(0, int)):
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(x.astype(np.uint32)).to_bytes())
        assert w.decoded().tolist() == x.tolist()
        for i in range(0, len(x), 997):
            assert w.access(i) == x[i]
        for t in {0, 1, 2, 70000, 99999}:
            assert w.count(t) == int((x == t).sum())
            assert w.count(t, len(x) // 3, len(x) // 2) == int((x[len(x) // 3 : len(x) // 2] == t).sum())
            assert w.positions(t).tolist() == np.flatnonzero(x == t).tolist()


@pytest.mark.parametrize("size", [16 << 20, 3000])
def test_sharding(spark, docs, size):
    rows, df = docs
    out = sharding.shuffle_to_shards(df.withColumn("slot", F.lit("clash")), 7, bucket_bytes=size).collect()
    assert collections.Counter((r.doc_id, r.text, r.start) for r in out) == collections.Counter(rows)
    sizes = collections.Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    again = sharding.shuffle_to_shards(df.repartition(9), 7, bucket_bytes=size).collect()
    assert {(r.doc_id, r.text, r.shard, r.slot) for r in again} == {(r.doc_id, r.text, r.shard, r.slot) for r in out}
    assert {(r.doc_id, r.shard) for r in sharding.shuffle_to_shards(df, 7, seed=1, bucket_bytes=size).collect()} != {(r.doc_id, r.shard) for r in out}


def test_sharding_by_lists(spark, docs):
    rows, df = docs
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    hashed = df.select("doc_id", "text", F.xxhash64(F.lit(sharding.SEED), "doc_id", crc).alias("at"), crc.alias("crc")).collect()
    buckets = math.ceil(sum(len((t or "").encode()) + 1 for _, t, _ in rows) / 3000)
    want, place = [], 0
    for number in range(buckets):
        own = sorted((r for r in hashed if r["at"] % buckets == number), key=lambda r: (r["at"], r.doc_id is not None, r.doc_id or 0, r.crc))
        picks = np.random.default_rng((sharding.SEED, number)).random(len(own))
        for i in range(len(own) - 1, 0, -1):
            k = int(picks[i] * (i + 1))
            own[i], own[k] = own[k], own[i]
        for r in own:
            shard = max(s for s in range(8) if place >= -(-len(rows) * s // 8))
            want.append((r.doc_id, r.text, shard, place - -(-len(rows) * shard // 8)))
            place += 1
    out = sharding.shuffle_to_shards(df, bucket_bytes=3000).collect()
    assert sorted(((r.doc_id, r.text, r.shard, r.slot) for r in out), key=str) == sorted(want, key=str)


def test_sharding_edges(spark, docs):
    _, df = docs
    assert sharding.digest(df.limit(0)).count() == 0
    few = sharding.digest(df.limit(3)).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3
    places = collections.Counter(tuple(sharding.fisher_yates(3, (s,))) for s in range(3000))
    assert len(places) == 6 and min(places.values()) > 400


def brute_ppm(text, counts, order):
    t = b" ".join(ppm.words_of(text)) + bytes([ppm.STOP])
    whole, out = bytes([ppm.START]) * order + t, 0.0
    for i in range(order, len(whole)):
        gone, seen = set(), False
        for k in range(order, -1, -1):
            rest = {a: n for a, n in counts.get(whole[i - k : i], {}).items() if a not in gone}
            if not rest:
                continue
            n, d = sum(rest.values()), len(rest)
            if whole[i] in rest:
                out += math.log10(rest[whole[i]] / (n + d))
                seen = True
                break
            out += math.log10(d / (n + d))
            gone |= set(rest)
        if not seen:
            out -= math.log10(ppm.SYMBOLS - len(gone))
    return out


@pytest.mark.parametrize("grams, block", [(2_000_000, 32 << 20), (100, 2000)])
def test_ppm(spark, docs, monkeypatch, grams, block):
    rows, df = docs
    monkeypatch.setattr(ppm, "GRAMS", grams)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", block)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts, words = {}, collections.Counter()
    for i, t, _ in rows:
        if not held(i):
            w = ppm.words_of((t or "").encode())
            words.update([*w, None])
            whole = bytes([ppm.START]) * ppm.ORDER + b" ".join(w) + bytes([ppm.STOP])
            for p in range(ppm.ORDER, len(whole)):
                for k in range(ppm.ORDER + 1):
                    counts.setdefault(whole[p - k : p], collections.Counter())[whole[p]] += 1
    total, distinct = sum(words.values()), len(words)
    want = []
    for i, t, _ in rows:
        w = [*ppm.words_of((t or "").encode()), None]
        base = sum(math.log10((words[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        want.append((str(i), held(i), len(w), sum(words[x] > 0 for x in w), total, base, brute_ppm((t or "").encode(), counts, ppm.ORDER) if len(w) < 400 else None))
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ppm.digest(df).collect()), key=str)
    want.sort(key=str)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        assert b[6] is None or a[6] == pytest.approx(b[6], rel=1e-5)


def test_ppm_edges(spark, docs):
    _, df = docs
    assert ppm.digest(df.limit(0)).count() == 0
    alike = ppm.score(df.where("doc_id = 500").select("doc_id", "text"), F.lit(False)).first()
    assert alike.score == pytest.approx(-math.log10(ppm.SYMBOLS), rel=1e-6)
    one = df.where("doc_id is null").select("doc_id", "text")
    r = ppm.digest(one).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (False, 3, 3, 3)
    again = one.withColumns({c: F.lit(5) for c in ("score", "block", "kind", "trains")})
    assert [r.n_known for r in ppm.score(again.union(again), F.lit(True)).collect()] == [3, 3]


def test_ppm_sums_to_one():
    texts = [b"the cat sat", b"the mat", b"a cat"]
    grams, counts = np.unique(ppm.windows(texts)[0], return_counts=True)
    trie = ppm.Trie(grams, counts, [ppm._summed([grams & ppm._mask(k)], [counts]) for k in (1, 2, 3)])
    for context in (b"", b"the ", b"zz", b"a c", b"mat"):
        before = (bytes([ppm.START]) * ppm.ORDER + context)[-ppm.ORDER :]
        each = np.array([int.from_bytes(before, "big") << 8 | s for s in range(256) if s != ppm.START], np.uint64)
        assert (10.0 ** trie.logs(each).astype(float)).sum() == pytest.approx(1, abs=1e-5)


def brute_top(rows, k, step):
    v = {}
    for i, x in rows:
        if i is not None and x and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, []).append([math.floor(64 * c) for c in x])
    out = {}
    for q, xs in v.items():
        if q % step == 0:
            x = min(xs)
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, ys in v.items() if i != q for y in ys if len(y) == len(x))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return {q: r for q, r in out.items() if r}


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=12) / 3)]) for i in range(400)]
    rows += [(i, [0.5] * 12) for i in range(400, 480)] + [(480, None), (481, []), (482, [None] + [0.1] * 11), (483, [float("nan")] * 12), (484, [float("inf")] * 12), (None, [0.1] * 12), (485, [0.0] * 12), (500, [0.25, 0.5]), (501, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(3)
    want = brute_top([(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows], 20, 20)
    for block, tile, queries in [(16_384, 64, 32_768), (32, 3, 5)]:
        monkeypatch.setattr(vafile, "BLOCK", block)
        monkeypatch.setattr(vafile, "TILE", tile)
        monkeypatch.setattr(vafile, "QUERIES", queries)
        got = collections.defaultdict(list)
        for r in vafile.digest(df).orderBy("query_id", "rank").collect():
            assert r.rank == len(got[r.query_id]) + 1
            got[r.query_id].append((r.vec_id, r.score))
        assert got == want
    assert vafile.digest(df.limit(0)).count() == 0
    v = vafile.whole_numbers(df)
    assert vafile.top_k(v, v.where("id = 500"), 5).collect()[0].vec_id == 501


def test_top_k_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, [float(c) for c in rng.normal(size=4) * 10.0 ** rng.integers(5, 18)]) for i in range(60)]
    rows += [(300, [1e300, -1.0, 0.0, 2.0]), (301, [-1e300, 0.5, 1.0, 0.0]), (320, [2e306, 0.0, 0.0, 0.0]), (321, [1e308, 0.0, 0.0, 0.0])]
    rows += [(340, [0.25] * 4)] * 70 + [(341, [0.25] * 4)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = brute_top([r for r in rows if r[0] != 321], 20, 20)
    got = collections.defaultdict(list)
    for r in vafile.digest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {q: [(i, max(-(2**63), min(2**63 - 1, s))) for i, s in found] for q, found in want.items()}
    numbers = [0, 1, -1, 9, -9, 10, -10, 10**40, -(10**40), 10**40 + 1, 5 * 10**600]
    assert sorted(numbers, key=vafile.sortable) == sorted(numbers)
