"""Exact deduplication by a log-structured merge index of digests, in DataFrame operations only.

Memtables (slices of the rows by a hash of their id) are flushed as sorted runs of
(digest, smallest id, largest id, rows). Each run has a filter: bitmaps over hashed digests. Compaction
merges only digests that another run's filter may hold; all others pass through. Documents then
probe the merged index, and the texts of every group are verified by their bytes: the least and the largest text of
a digest, combined before they are dealt, are equal only if all are. Digests under which texts differ are regrouped
by the text itself. Only texts of groups are dealt: a filter over the ids in groups, of at most common.PROBE_BITS bits, is
sent to the scan; with more groups than it holds it lets more texts pass, which changes no result.

Runs are files sorted by digest, which makes them small; Spark joins no sorted files without dealing them, so that
compaction deals what several runs may hold and sorts it again.

Nulls and edge cases: a null text counts as empty; rows with a null id form no special case but a null
is never kept while a non-null id exists; repeated ids are separate rows; an empty table gives no rows;
further columns are ignored, whatever their names. Letters other than A-Z are compared as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import BITMAP_BITS, BITS_PER_KEY, ascii_lower, bitmap_has, bitmap_slot, documents, maybe_in
from paperloom.scratch import discard, written



def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def flush_runs(rows: DataFrame, memtables: int) -> DataFrame:
    """Sorted runs of (run, digest, low_id, high_id, n)."""
    run = F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int").alias("run")
    runs = rows.groupBy(run, "digest").agg(F.min("doc_id").alias("low_id"), F.max("doc_id").alias("high_id"), F.count(F.lit(1)).alias("n"))
    return written(runs.sortWithinPartitions("run", "digest"), "digest-runs")


def run_filters(runs: DataFrame, memtables: int, buckets: int) -> DataFrame:
    """One row a bucket with the bitmaps of all runs; 4 KB a bitmap."""
    bucket, bit = bitmap_slot(buckets, "digest")
    each = runs.select("run", bucket, bit).groupBy("bucket", "run").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return each.groupBy("bucket").agg(*[F.max(F.when(F.col("run") == g, F.col("bits"))).alias(f"bits_{g}") for g in range(memtables)])


def compact(runs: DataFrame, memtables: int) -> DataFrame:
    """One row a digest: (digest, low_id, high_id, n)."""
    largest = runs.groupBy("run").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-largest * BITS_PER_KEY // BITMAP_BITS))
    bucket, bit = bitmap_slot(buckets, "digest")
    probed = runs.select("*", bucket, bit).join(run_filters(runs, memtables, buckets), "bucket")
    elsewhere = F.lit(False)
    for g in range(memtables):
        elsewhere = elsewhere | ((F.col("run") != g) & bitmap_has(F.col(f"bits_{g}"), F.col("bit")))
    probed = written(probed.select("digest", "low_id", "high_id", "n", elsewhere.alias("elsewhere")), "digest-probed")
    merged = probed.filter("elsewhere").groupBy("digest").agg(F.min("low_id").alias("low_id"), F.max("high_id").alias("high_id"), F.sum("n").alias("n"))
    index = written(probed.filter("not elsewhere").select(*merged.columns).unionByName(merged).sortWithinPartitions("digest"), "digest-index")
    discard(runs, probed)
    return index


def exact_duplicates(docs: DataFrame, *, keep: str = "largest", memtables: int = 4, digest=sha256_digest) -> DataFrame:
    """Return (doc_id, keep_id, group_size, kept, digest) for every row of docs (doc_id, text).

    keep names the row that stays: the one with the largest or the smallest id. digest is a function of
    the normalised text; a weak one only costs time, as hits are verified by their bytes."""
    winner = {"largest": "high_id", "smallest": "low_id"}[keep]
    best = {"largest": F.max, "smallest": F.min}[keep]
    text = ascii_lower(F.col("text"))
    rows = written(docs.select("doc_id", digest(text).alias("digest")), "digests")
    index = compact(flush_runs(rows, memtables), memtables)
    found = written(rows.join(index.select("digest", F.col(winner).alias("keep_id"), F.col("n").alias("group_size")), "digest"), "digest-found")
    discard(rows, index)

    # Byte verification of the texts of groups.
    members = maybe_in(docs.select("doc_id", "text"), found.filter("group_size > 1"), "doc_id").filter("maybe")
    members = members.select("doc_id", text.alias("norm")).withColumn("digest", digest(F.col("norm")))
    differing = members.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a != b").select("digest")
    differing = written(differing, "digest-differing")
    if differing.isEmpty():
        discard(differing)
    else:
        apart = written(members.join(differing, "digest"), "digest-apart")
        regrouped = written(apart.groupBy("digest", "norm").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-regrouped")
        again = apart.select("doc_id", "digest", "norm").join(regrouped, ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size")
        found = found.join(differing, "digest", "left_anti").select(*again.columns).unionByName(again)
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir))
    return found.withColumnRenamed("digest", "text_sha256")


OP8_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
