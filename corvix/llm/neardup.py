"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import dropped, each_text, released, runs, spread_join, trimmed, written
from .components import connected_components

WIDTH = 5
#: Bands at most, and the share of pairs at the threshold that may agree on none of them.
BANDS, MISSED = 32, 1e-5
#: Classes of a candidate component that one task compares at once, and their shingles.
GROUP, PART = 4096, 2_000_000
#: Members of a larger component that a task compares with a pivot.
BLOCK = 64
#: Up to this many document ids (8 bytes each) are broadcast to pick out candidates' texts.
BROADCAST_IDS = 100_000
WORDS_KEPT = 100_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, kept while there are few of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: bytes | None, words: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text.

    A-Z are lower-cased; words are what stands between ASCII white space. A text of fewer words than
    `width` is one shingle; without words there is none.
    """
    if not text or not (found := text.lower().split()):
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mix(out * GOLDEN + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def superminhash(x: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signature of m components of a set of 64-bit hashes.

    At rank j each element offers j + r, r uniform in [0, 1), to the component that its own random
    permutation has at place j (a Fisher-Yates shuffle run one step a rank). Offers of rank j are at
    least j; so once every component is at most j + 1, later ranks can change nothing.
    """
    h, places = np.full(m, np.inf), None
    with np.errstate(over="ignore"):
        for j in range(m):
            z = _mix(x + np.uint64(j + 1) * GOLDEN)
            r = j + (z >> np.uint64(11)).astype(np.float64) * 2.0**-53
            k = j + ((_mix(z) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            if j == 0:
                slot, first = k, k
            else:
                rows = np.arange(len(x))
                if places is None:
                    places = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
                    places[rows, first], places[rows, 0] = 0, first
                slot = places[rows, k].copy()
                places[rows, k], places[rows, j] = places[rows, j], slot
            np.minimum.at(h, slot, r)
            if h.max() <= j + 1:
                break
    return h


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which at most 32 bands miss a pair at the threshold once in 100,000."""
    best = (BANDS, 1)
    for rows in range(1, 64):
        agree = (percent / 100) ** rows
        bands = math.ceil(math.log(MISSED) / math.log1p(-agree)) if agree < 1 else 1
        if bands > BANDS:
            break
        best = (bands, rows)
    return best


def band_keys(signature: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed 64-bit key for each band; keys of different bands differ."""
    parts = signature.reshape(bands, rows)
    return [xxhash.xxh3_64_intdigest(parts[i].tobytes(), i) - 2**63 for i in range(bands)]


def _signed(width: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        words = _Words()
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in each_text(batch["text"]):
                x = shingles(text, words, width)
                sizes.append(len(x))
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                keys.append(band_keys(superminhash(x, bands * rows), bands, rows) if len(x) else [])
            yield pa.record_batch([batch["doc_id"], batch["key"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)
        trimmed()

    return run, "doc_id long, key long, n_shingles long, digest binary, bands array<long>"


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sorted distinct arrays."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _members(rows: list[dict], words: dict, width: int) -> tuple[list[int], list[np.ndarray]]:
    """Numbers and sets of a group's classes."""
    rows.sort(key=lambda r: r["rep"])
    return [r["rep"] for r in rows], [shingles(r["text"], words, width) for r in rows]


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def group_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (by place) that connect sets as all their links would.

    Sets that can't have a link, because too many of their shingles are in no other set (see _linkable()),
    are left out. Of the others one after another is compared with all, by counting how often each set
    occurs among the holders of its shingles; first the one with the most common shingles, then sets
    that are not in the largest component of those not yet compared. When these are one component, no
    pair is left that could change one. Sets that share much and yet have few links are all compared: at worst
    every set with every other, of the 4096 that a group may have.
    """
    m, n = len(sets), np.array([len(x) for x in sets])
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), n)
    alive = np.ones(m, bool)
    while True:
        held = np.bincount(shingle[alive[owner]], minlength=int(shingle.max()) + 1)
        own = np.bincount(owner[held[shingle] == 1], minlength=m)
        bad = alive & (100 * (n - own) < percent * n)
        if not bad.any():
            break
        alive &= ~bad
    left = alive[owner]
    holders = owner[left][np.argsort(shingle[left], kind="stable")]
    first = np.concatenate(([0], np.cumsum(held)[:-1]))
    begins = np.concatenate(([0], np.cumsum(n)[:-1]))
    label, links = np.arange(m), []
    weight = np.bincount(owner, held[shingle], m) / np.maximum(n, 1)
    todo = alive.copy()
    nxt = int(np.where(alive, weight, -1).argmax())
    while todo.any():
        own = shingle[begins[nxt] : begins[nxt] + n[nxt]]
        counts, starts = held[own], first[own]
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        common = np.bincount(holders[at], minlength=m)
        near = np.flatnonzero(alive & (100 * common >= percent * (n + n[nxt] - common)))
        for other in np.unique(label[near]).tolist():
            if other != label[nxt]:
                links.append((nxt, int(near[label[near] == other][0])))
        label[np.isin(label, label[near])] = label[nxt]
        todo[nxt] = False
        rest = np.flatnonzero(todo)
        if not len(rest):
            break
        apart = rest[label[rest] != np.bincount(label[rest]).argmax()]
        if not len(apart):
            break
        nxt = int(apart[0])
    return links


def _links_within(width: int, percent: int):
    """group_links() of each bounded group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for rows in runs(batches, "grp"):
            ids, sets = _members(rows, words, width)
            links = group_links(sets, percent) if len(ids) > 1 else []
            if links:
                yield pa.record_batch([pa.array([ids[x] for x, _ in links], pa.int64()), pa.array([ids[y] for _, y in links], pa.int64())], schema=EDGES)
        trimmed()

    return run


def _links_to_pivot(width: int, percent: int):
    """Links between a block's pivot and the other members of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for rows in runs(batches, "grp"):
            ids, sets = _members(rows, words, width)
            at = ids.index(rows[0]["pivot"]) if rows[0]["pivot"] in ids else None
            found = [] if at is None else [x for x, s in zip(ids, sets) if x != ids[at] and similar(s, sets[at], percent)]
            if found:
                yield pa.record_batch([pa.array([ids[at]] * len(found), pa.int64()), pa.array(found, pa.int64())], schema=EDGES)

    return run


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, once: bool) -> DataFrame:
    """(rep, text) of the classes whose numbers are in column `rep` of wanted: the text of the row that stands for a class.

    Where the same row may be there many times (not `once`), equal ones are reduced to one before they meet.
    """
    rows = classes.join(wanted, "rep", "left_semi").select("rep", F.col("least").alias("doc_id"), "key")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = _given(docs).where("text is not null").join(F.broadcast(rows) if few else rows, ["doc_id", "key"])
    texts = texts.select("rep", F.col("text").cast("binary").alias("text"))
    return texts if once else texts.groupBy("rep").agg(F.min("text").alias("text"))


def _given(docs: DataFrame) -> DataFrame:
    """doc_id, text and `key`, a hash that tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text")).select("doc_id", "key", "text")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text, ...).

    Documents whose sets of `width`-word shingles have 100 * intersection >= percent * union are
    linked; component_id is the smallest doc_id of a document's component, kept says whether it is the
    document's own.

    Equal sets are one class, so copies cost nothing further. Each class has a SuperMinHash signature;
    classes that agree on a whole band are candidates (see banding()). Links are confirmed on full sets.
    Candidate components of up to 4096 classes and two million shingles are compared within one task, by
    group_links(). Larger ones first lose the classes that can't have a link, because too many of
    their shingles are in no other class of the component, and are split anew. In those that stay large,
    every bucket is compared with some pivots at a time, in blocks of 64 members, and drops them afterwards,
    until what is left of it is connected. So no pair of a bucket is left out that could change a component.

    Null and empty texts, and those without words, have empty sets and are their own component. Rows
    with a null doc_id have a null component_id and are kept. Rows that share a doc_id are each compared
    with all others, and returned; as they are one document, those that are not empty are in one component. An
    empty table gives no rows. Other columns are ignored.
    """
    bands, rows = banding(percent)
    run, kind = _signed(width, bands, rows)
    signed = written(_given(docs).mapInArrow(run, kind), "signed")
    real, total = signed.where("n_shingles > 0 and doc_id is not null"), signed.count()
    classes = real.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("n"), F.any_value("n_shingles").alias("shingles"), F.any_value("bands").alias("bands"))
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), "digest", F.col("first.doc_id").alias("least"), F.col("first.key").alias("key"), "n", "shingles", "bands")
    classes = written(classes, "classes")
    own = F.xxhash64("digest")
    repeated = real.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(own).alias("lo"), F.max(own).alias("hi")).where("n > 1")
    once = repeated.isEmpty()
    in_bands = classes.select("rep", F.explode("bands").alias("bucket"))
    members = _shared_buckets(in_bands, classes.count() * bands)
    small, large = _split(members, classes)
    links = _within(_texts(docs, classes, small.select("rep"), once).join(small, "rep"), width, percent)
    if not large.isEmpty():
        texts = written(_texts(docs, classes, large.select("rep"), once).join(large, "rep"), "texts")
        left = _linkable(texts, width, percent)
        members = _shared_buckets(members.select("rep", "bucket").join(left, "rep", "left_semi"), members.count())
        small, large = _split(members, classes)
        links = links.union(_within(texts.drop("grp").join(small, "rep"), width, percent))
        if not large.isEmpty():
            links = links.union(_large_links(texts.drop("grp"), large.select("rep"), members, width, percent))
    if not once:
        links = links.union(_same_document(real, repeated, classes, total))
    labels = connected_components(links).withColumnRenamed("node", "rep")

    linked = labels.join(classes.select("rep", "least"), "rep")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(labels, least, ["label"], "n", ["rep"], total).select("rep", "component_id")
    component = classes.select("rep", "digest", "least", "n").join(named, "rep", "left")
    component = component.select("digest", F.coalesce("component_id", "least").alias("component_id"), "n")
    found = spread_join(real.select("doc_id", "n_shingles", "digest"), component, ["digest"], "n", [], total)
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _same_document(real: DataFrame, repeated: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    rows = spread_join(real.select("doc_id", "digest"), repeated.where("lo != hi").select("doc_id", "n"), ["doc_id"], "n", [], total)
    kinds = written(rows.distinct(), "kinds")
    held = kinds.groupBy("digest").agg(F.count("*").alias("n")).join(classes.select("digest", "rep"), "digest")
    of = written(spread_join(kinds, held, ["digest"], "n", [], total).select("doc_id", "rep"), "of")
    first = of.groupBy("doc_id").agg(F.min("rep").alias("first"), F.count("*").alias("n"))
    return spread_join(of, first, ["doc_id"], "n", [], total).where("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b"))


def _shared_buckets(in_bands: DataFrame, total: int) -> DataFrame:
    """(bucket, rep, size, first) of buckets with several members, from (rep, bucket)."""
    buckets = in_bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("first")).where("size > 1")
    return written(spread_join(in_bands, buckets.withColumn("n", F.col("size")), ["bucket"], "n", ["rep"], total), "members")


def _split(members: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, grp) of small candidate components and of large ones; grp is the component."""
    candidates = connected_components(members.select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct())
    sized = written(candidates.withColumnRenamed("node", "rep").join(classes.select("rep", "shingles"), "rep"), "sized")
    small = (F.count("*") <= GROUP) & (F.sum("shingles") <= PART)
    sizes = sized.groupBy("label").agg(F.count("*").alias("n"), small.alias("small"))
    grouped = spread_join(sized, sizes, ["label"], "n", ["rep"], sized.count())
    grouped = written(grouped.select("rep", F.col("label").alias("grp"), "small"), "grouped")
    return grouped.where("small").select("rep", "grp"), grouped.where("not small").select("rep", "grp")


def _within(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links within the groups of (rep, grp, text)."""
    dealt = texts.repartition("grp").sortWithinPartitions("grp").select("grp", "rep", "text")
    return written(dealt.mapInArrow(_links_within(width, percent), "a long, b long"), "links")


def _dealt_shingles(width: int):
    """Each text's shingles, dealt by hash to parts of its group, as arrays."""
    names = ["grp", "part", "rep", "n", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            rows = []
            for grp, parts, rep, text in zip(batch["grp"].to_pylist(), batch["parts"].to_pylist(), batch["rep"].to_pylist(), each_text(batch["text"])):
                x = shingles(text, words, width)
                of = (x % np.uint64(parts)).astype(np.int64)
                x = x[np.argsort(of, kind="stable")]
                edges = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=parts)))).tolist()
                rows += [(grp, k, rep, len(x), x[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)

    return run


def _own_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a part each member alone has."""
    for rows in runs(batches, "key"):
        sets = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        _, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        begins = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1]))
        own = np.add.reduceat((counts[back] == 1).astype(np.int64), begins)
        yield pa.record_batch([pa.array([r["rep"] for r in rows], pa.int64()), pa.array([r["n"] for r in rows], pa.int64()), pa.array(own)], names=["rep", "n", "own"])


def _linkable(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep) of the members of (rep, grp, text) that a link of their group may hold.

    A set of n shingles of which no other member has `own` has at most n - own in common with any, and any
    union has at least n; so it has no link if 100 * (n - own) < percent * n. Those go, and again, as long
    as a twentieth goes at a time. A group's shingles are dealt to parts of about PART, each one task's.
    """
    words = texts.groupBy("grp").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sized = texts.join(words.select("grp", F.ceil(F.col("bytes") / (6 * PART)).alias("parts")), "grp")
    dealt = written(sized.select("grp", "parts", "rep", "text").mapInArrow(_dealt_shingles(width), "grp long, part long, rep long, n long, hashes binary"), "shingles")
    left = texts.select("rep")
    before, after = None, left.count()
    while before is None or after < 0.95 * before:
        keyed = dealt.join(left, "rep", "left_semi").withColumn("key", F.xxhash64("grp", "part"))
        counts = keyed.select("key", "rep", "n", "hashes").repartition("key").sortWithinPartitions("key").mapInArrow(_own_shingles, "rep long, n long, own long")
        kept = counts.groupBy("rep").agg(F.max("n").alias("n"), F.sum("own").alias("own"))
        left = written(kept.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")).select("rep"), "left")
        before, after = after, left.count()
    dropped(dealt)
    return left


def _large_links(texts: DataFrame, large: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that connect the members of large candidate components as all links would.

    Each round takes, in every open bucket, the members in most and largest buckets as pivots (4, then 32,
    256, ...), compares them with all members that have another label, relabels, and drops the pivots.
    A bucket is closed when its remaining members have one label.
    """
    opened = written(members.join(large, "rep", "left_semi").select("bucket", "rep", "size"), "open")
    weight = opened.groupBy("rep").agg(F.sum("size").alias("weight"))
    opened, before = written(opened.join(weight, "rep").select("bucket", "rep", "weight"), "open"), opened
    dropped(before)
    labels = written(large.select("rep", F.col("rep").alias("label")).distinct(), "labels")
    found: list[DataFrame] = []
    pivots = 4
    while not opened.isEmpty():
        best = W.partitionBy("bucket").orderBy(F.desc("weight"), "rep")
        chosen = opened.withColumn("at", F.row_number().over(best)).where(F.col("at") <= pivots)
        chosen = written(chosen.select("bucket", F.col("rep").alias("pivot")), "pivots")
        counts = opened.groupBy("bucket").agg(F.count("*").alias("n"))
        total = opened.count()
        star = spread_join(opened.select("bucket", "rep"), counts.join(chosen, "bucket").groupBy("bucket", "n").agg(F.collect_list("pivot").alias("ps")), ["bucket"], "n", ["rep"], total)
        pairs = star.select("rep", F.explode("ps").alias("pivot")).where("rep != pivot").distinct()
        own = labels.select("rep", F.col("label").alias("own"))
        pairs = pairs.join(own, "rep")
        per = pairs.groupBy("pivot").agg(F.count("*").alias("n"))
        per = per.join(labels.select(F.col("rep").alias("pivot"), F.col("label").alias("theirs")), "pivot").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        pairs = spread_join(pairs, per, ["pivot"], "n", ["rep"], total * pivots).where("own != theirs")
        block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
        pairs = written(pairs.select("rep", "pivot", F.xxhash64("pivot", block).alias("grp")), "pairs")
        groups = pairs.union(pairs.select(F.col("pivot").alias("rep"), "pivot", "grp").distinct())
        blocks = groups.join(texts, "rep").repartition("grp").sortWithinPartitions("grp").select("grp", "pivot", "rep", "text")
        links = written(blocks.mapInArrow(_links_to_pivot(width, percent), "a long, b long"), "links")
        found.append(links)

        merged = connected_components(_relabelled(links, labels))
        sizes = labels.groupBy("label").agg(F.count("*").alias("n")).join(merged.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left")
        labels, before = written(spread_join(labels, sizes, ["label"], "n", ["rep"], labels.count()).select("rep", F.coalesce("_to", "label").alias("label")), "labels"), labels
        dropped(before, pairs)
        rest = opened.join(chosen.withColumnRenamed("pivot", "rep"), ["bucket", "rep"], "left_anti").join(labels, "rep")
        state = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        still = spread_join(rest, state.withColumn("open", F.col("lo") != F.col("hi")), ["bucket"], "n", ["rep"], total).where("open")
        opened, before = written(still.select("bucket", "rep", "weight"), "open"), opened
        dropped(before, chosen)
        pivots *= 8
    dropped(opened)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _relabelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("rep").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("rep").alias("b"), F.col("label").alias("lb"))
    n = links.groupBy("a").agg(F.count("*").alias("n"))
    out = spread_join(links, n.join(a, "a"), ["a"], "n", ["b"], links.count())
    return out.join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, n || ':' || array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.y, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(l.y, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_of l ON l.x = w.doc_id
"""
