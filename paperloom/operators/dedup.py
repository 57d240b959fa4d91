"""Matching documents against stored ones: equal bytes and near perceptual hashes.

new: document_id, file_hash, perceptual_hash, seq. stored: the same. Hashes are 16 hexadecimal digits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.scratch import discard, written

#: Bytes of a hash that make one key: at most 5 of 64 bits differing leave 3 of 8 bytes equal, so one of the 56 keys of
#: 24 bits is. Unlike hashes share a key with probability 56 / 2^24.
BYTES, KEPT = 8, 3
KEYS = tuple(combinations(range(BYTES), KEPT))


def halves(h: Column) -> tuple[Column, Column]:
    return tuple(F.conv(F.substring(h, a, 8), 16, 10).cast("long") for a in (1, 9))


def hamming(a: Column, b: Column) -> Column:
    (a1, a2), (b1, b2) = halves(a), halves(b)
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def valid(h: Column) -> Column:
    return h.rlike("^[0-9a-fA-F]{16}$")


def _keyed(df: DataFrame) -> DataFrame:
    part = lambda i: F.substring("h", 2 * i + 1, 2)
    keys = F.array(*[F.concat(F.lit(f"{at}:"), *[part(i) for i in key]) for at, key in enumerate(KEYS)])
    return df.select("*", F.explode(keys).alias("key"))


def near_pairs(left: DataFrame, right: DataFrame, distance: int = K.HASH_DISTANCE) -> DataFrame:
    """Distinct pairs of hashes (h, r, distance) of left (h) and right (h) within distance (at most 5). Equal hashes
    were made one before, so copies are not paired with each other."""
    if distance > BYTES - KEPT:
        raise ValueError("keys of 3 in 8 bytes find at most 5 differing bits")
    a = _keyed(left.select("h").distinct())
    b = _keyed(right.select("h").distinct()).withColumnRenamed("h", "r")
    d = hamming(F.col("h"), F.col("r"))
    # Spark takes exploded keys to be as few as their hashes: they are dealt and merged, never broadcast through the driver.
    return a.join(b.hint("merge"), "key").filter(d <= distance).select("h", "r", d.alias("distance")).distinct()


def find_duplicates(new: DataFrame, stored: DataFrame, distance: int = K.HASH_DISTANCE) -> DataFrame:
    """(document_id, matched_document_id, match_type, distance) of new documents with a match: by bytes the one
    stored first; else by the least distance, then stored first. A document does not match itself."""
    exact = stored.groupBy("file_hash").agg(F.min_by("document_id", "seq").alias("matched_document_id"))
    by_bytes = new.join(exact, "file_hash").select("document_id", "matched_document_id", F.lit("exact_hash").alias("match_type"), F.lit(None).cast("int").alias("distance"))
    lower = lambda df: df.filter(valid(F.col("perceptual_hash"))).withColumn("h", F.lower("perceptual_hash"))
    rest = lower(new.join(by_bytes.select("document_id"), "document_id", "left_anti"))
    held = lower(stored).groupBy("h").agg(F.min(F.struct("seq", "document_id")).alias("first"))
    pairs = near_pairs(rest, held, distance).join(held.withColumnRenamed("h", "r"), "r")
    best = pairs.groupBy("h").agg(F.min(F.struct("distance", F.col("first.seq").alias("seq"), F.col("first.document_id").alias("document_id"))).alias("m"))
    by_look = rest.join(best, "h").select("document_id", F.col("m.document_id").alias("matched_document_id"), F.lit("perceptual_hash_similarity").alias("match_type"), F.col("m.distance").cast("int").alias("distance"))
    return by_bytes.unionByName(by_look).filter("document_id != matched_document_id")


def accepted_in_order(documents: DataFrame, distance: int = K.HASH_DISTANCE) -> DataFrame:
    """Ids that are kept when documents (document_id, file_hash, perceptual_hash, seq) come one by one and each is
    dropped that matches one kept before. Rounds: kept are those without an undecided earlier match, dropped those
    with a kept one. Copies of the same hashes are decided by their first."""
    first = documents.filter(valid(F.col("perceptual_hash"))).withColumn("h", F.lower("perceptual_hash")).groupBy("h").agg(F.min("seq").alias("seq"))
    first = written(first, "hash-firsts")
    links = near_pairs(first, first, distance).filter("h != r").join(first.select("h", F.col("seq").alias("seq_h")), "h").join(first.select(F.col("h").alias("r"), F.col("seq").alias("seq_r")), "r")
    links = written(links.filter("seq_h < seq_r").select("h", "r"), "hash-links")
    undecided, kept = first.select("h"), None
    while True:
        later = links.join(undecided, "h", "left_semi").select(F.col("r").alias("h")).distinct()
        now = written(undecided.join(later, "h", "left_anti"), "hash-kept")
        if now.isEmpty():
            break
        kept = now if kept is None else kept.union(now)
        dropped = links.join(now, "h", "left_semi").select(F.col("r").alias("h")).distinct()
        undecided, done = written(undecided.join(now, "h", "left_anti").join(dropped, "h", "left_anti"), "hash-undecided"), undecided
        discard(done)
    if kept is None:
        kept = first.select("h")
    held = documents.withColumn("h", F.lower("perceptual_hash")).join(kept.join(first, "h"), ["h", "seq"]).select("document_id", "file_hash", "seq")
    unhashed = documents.filter(F.col("perceptual_hash").isNull() | ~valid(F.col("perceptual_hash"))).select("document_id", "file_hash", "seq")
    return held.unionByName(unhashed).groupBy("file_hash").agg(F.min_by("document_id", "seq").alias("document_id")).select("document_id")
