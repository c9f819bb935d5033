"""Line dedup: range-partitioned line hashes, streamed in document order, give keep bitmaps. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import TASK_ROWS, hot_threshold, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 20
LEAST_DOCS = 3
#: Lines of one bitmap word.
BITS = 64


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _row() -> Column:
    """Tells rows that share a doc_id apart, unless their texts are equal too."""
    return F.xxhash64(F.lit("row"), F.coalesce(F.col("text"), F.lit("")))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, row_hash and `lost` for the documents that lose lines: a sparse bitmap map<word, bits>.

    Bit i of word w stands for line 64 * w + i; a set bit is a line that goes, words without one are left
    out, so an absent document keeps all its lines. 16 bytes of hash stand for a line's key. Keys with
    more lines than hot_threshold() (a 512th of all or a million; 2**20 keys at most) are settled by a pre-aggregated
    count and broadcast. The others are range-partitioned by hash, a million lines or fewer a partition, and sorted by
    document, largest first, and position; the first document of a key that streams by keeps its lines.
    """
    lines = docs.select("doc_id", _row().alias("row_hash"), F.posexplode(F.transform(_lines(), _key)).alias("pos", "key"))
    lines = lines.where(F.char_length("key") >= least_chars)
    lines = written(lines.select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")), "lines")

    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    total = lines.count()
    # What is broadcast is one file: Hadoop starts up to three processes (chmod) for each file that a task writes locally.
    hot = written(counts.where(F.col("n") > hot_threshold(total)).select("h1", "h2").repartition(1), "hot")
    rest, gone_hot = lines, None
    if not hot.isEmpty():
        keys = F.broadcast(hot)
        per_doc = lines.join(keys, ["h1", "h2"]).groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        stats = written(per_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")).repartition(1), "stats")
        later = (F.col("docs") >= least_docs) & ~F.col("doc_id").eqNullSafe(F.col("last"))
        gone_hot = lines.join(F.broadcast(stats), ["h1", "h2"]).where(later).select("doc_id", "row_hash", "pos")
        rest = lines.join(keys, ["h1", "h2"], "left_anti")

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_ROWS))
    largest_first = F.desc_nulls_last("doc_id")
    ranged = rest.repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", largest_first, "pos")
    same = W.partitionBy("h1", "h2")
    streamed = ranged.withColumn("nth", F.dense_rank().over(same.orderBy(largest_first))).withColumn("docs", F.max("nth").over(same))
    gone = streamed.where((F.col("docs") >= least_docs) & (F.col("nth") > 1)).select("doc_id", "row_hash", "pos")
    if gone_hot is not None:
        gone = gone.unionByName(gone_hot)
    gone = gone.withColumn("word", F.floor(F.col("pos") / BITS).cast("int"))
    words = gone.groupBy("doc_id", "row_hash", "word").agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).alias("bits"))
    return words.groupBy("doc_id", "row_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("lost"))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with `text` without repeated lines, and n_lines (before) and n_dropped.

    A text is split at \\n; null and empty texts are one empty line. A line's key is the line without
    ASCII white space at its ends, A-Z lower-cased. Keys of at least `least_chars` code points found in
    at least `least_docs` documents (different doc_ids; a null doc_id is one, the smallest) lose all
    their lines except in the largest doc_id that holds them, where all stay. The lines left are joined by
    \\n, so a text may become empty; a null text becomes empty. Rows that share a doc_id are parts of one
    document for this and each get their own text back. Other columns stay as they are; the names
    row_hash, lost, n_lines and n_dropped are taken (columns of docs with these names are replaced).
    """
    docs = docs.drop("row_hash", "lost", "n_lines", "n_dropped")
    lost = keep_bitmaps(docs, least_chars, least_docs)
    lost = lost.select(F.col("doc_id").alias("_doc"), "row_hash", "lost")
    joined = docs.withColumn("row_hash", _row()).alias("d").join(lost.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l._doc")) & (F.col("d.row_hash") == F.col("l.row_hash")), "left")
    joined = joined.select("d.*", "l.lost").drop("row_hash")
    lines = _lines()

    def stays(line: Column, at: Column) -> Column:
        bits = F.coalesce(F.try_element_at("lost", F.floor(at / BITS).cast("int")), F.lit(0).cast("long"))
        return F.getbit(bits, at % BITS) == 0

    kept = F.when(F.col("lost").isNull(), lines).otherwise(F.filter(lines, stays))
    out = joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn("_kept", kept)
    out = out.withColumn("n_dropped", F.col("n_lines") - F.size("_kept")).withColumn("text", F.array_join("_kept", "\n"))
    return out.drop("lost", "_kept")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document's remaining text."""
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, p, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS p
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
repeated AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
flagged AS (
  SELECT x.doc_id, x.p, x.l, r.k IS NOT NULL AND x.doc_id <> r.last AS gone
  FROM lines x LEFT JOIN repeated r ON x.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
