"""Removal of word sequences that repeat across documents, by level-wise doubling.

Of the windows of `length` words only those go on from level to level whose part at the level before also stands in
another document. Level one is a part of `SEED_WORDS` words: of those in a window the one with the least hash, so that
equal windows have equal parts at equal places, and neighbouring windows share theirs (their anchor). Each further level
doubles the part, while twice its length fits: the anchor and the words behind it, or, where the window ends before,
the anchor and the words before it. The last level is the window itself. It ends where no window is left.

All levels of an anchor are compared in one deal by the hash of its seed. With it goes one hash of the whole stretch that the
windows of the anchor cover: where an earlier document has an equal stretch, all of them are settled at once, which are nearly all
that repeat. Left are anchors at the edges of what documents share: the windows of these, and of the first of each other kind
with their seed, are made from the texts, known by 128 bits, and compared.

Seeds that very many documents hold (HOT_SHARE of them, or HOT_ROWS, by a sample; a list of at most HOT_SEEDS) are known to repeat;
they are dealt apart in SALTS parts, pass the levels, and the first of each kind in a part are compared by counts that are
combined before they are dealt. Which seeds these are changes no result. Windows are judged on the input, not on what is left. What a
document repeats within itself is sent once and marked; the last step covers its other places too.

A stretch is known by 64 bits of its seed and 64 of itself, of another base; a window by 64 of each base.

A null text has no words. Documents shorter than a window keep all words. Rows with a null id keep all words and
are nobody's earlier document. Every row stands for itself: of rows that repeat an id, those with equal texts get equal
results, and those with other texts are neither compared with each other (no id is smaller) nor share removals. Texts
of any length are read whole. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import WORD, documents, map_batches, maybe_in
from paperloom.scratch import discard, written

LENGTH, SEED_WORDS = 13, 4
SAMPLE_DOCUMENTS, SAMPLE_SHARE = 20_000, 20_000  #: documents, about, in which very common seeds are looked for: so many, or one of so many
HOT_SHARE, HOT_ROWS, LEAST_HOT, HOT_SEEDS, SALTS = 0.002, 200_000, 20, 1_000_000, 64
SALT_STEP = 0x9E3779B97F4A7C  #: times the salt is what a common seed is changed by for the deal
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(parts: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))


class Ranges:
    """Hashes of any range of words: differences of prefix sums, scaled to the range's start."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, h: np.ndarray, base: int = 0):
        power, self.inverse = self._tables(base, len(h) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)))

    @classmethod
    def _tables(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            n = max(n, 4096) * 2
            inverse = pow(int(BASES[base]), -1, 1 << 64)
            with np.errstate(over="ignore"):
                have = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, np.uint64(b)))), dtype=np.uint64) for b in (BASES[base], inverse))
            cls._powers[base] = have
        return have

    def get(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[start]) * self.inverse[start]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xC2B2AE3D27D4EB4F)
            return x ^ (x >> np.uint64(29))


def levels(length: int, seed_words: int) -> list[int]:
    """Lengths of the doubled parts: a part of such a length holds the anchor and lies in the window on one side of it."""
    out, n = [], 2 * seed_words
    while 2 * n <= length + seed_words + 1 and n < length:
        out.append(n)
        n *= 2
    return out


class Anchors:
    """Anchors of a document's windows, in order, each for a run of neighbouring windows.

    seed; first window and number of windows; offset of the anchor in the first window; whole, the stretch that they cover; right and
    left, for each level, with the anchor's doubled part or -1 where no window needs it."""

    def __init__(self, h: np.ndarray, length: int, seed_words: int):
        n = len(h) - length + 1
        ranges = Ranges(h)
        at = np.arange(len(h) - seed_words + 1)
        grams = ranges.get(at, at + seed_words)
        place = sliding_window_view(grams, length - seed_words + 1).argmin(axis=1) + np.arange(n)
        self.first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        self.count = np.diff(np.append(self.first, n))
        anchor = place[self.first]
        self.offset = anchor - self.first
        self.seed = grams[anchor]
        self.parts = []
        for size in levels(length, seed_words):
            last = self.offset - self.count + 1
            for wanted, a in ((last + size <= length, anchor), (self.offset + size > length, anchor + seed_words - size)):
                part = np.full(len(anchor), -1, np.int64)
                part[wanted] = (ranges.get(a[wanted], a[wanted] + size) >> np.uint64(33)).astype(np.int64)
                self.parts.append(part)
        self.whole = Ranges(h, 1).get(self.first, self.first + self.count + length - 1)

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors that are the first of their like in the document, and whether there are more."""
        with np.errstate(over="ignore"):
            own = (self.whole * np.uint64(31) + self.count.astype(np.uint64)) * np.uint64(1021) + self.offset.astype(np.uint64)
        _, at, n = np.unique(own, return_index=True, return_counts=True)
        return at, n > 1


def hot_seeds(texts: DataFrame, length: int, seed_words: int) -> np.ndarray:
    """Seeds that at least HOT_SHARE of the documents hold, or HOT_ROWS of them where that is less, by a sample; the HOT_SEEDS most
    frequent of them at most."""
    n = texts.count()
    wanted = max(SAMPLE_DOCUMENTS, n // SAMPLE_SHARE)
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // wanted))) == 0)

    def work(batch):
        found = [np.empty(0, np.int64)]
        for text in batch.column("text").to_pylist():
            h = word_hashes(words(text))
            if len(h) >= length:
                found.append(np.unique(Anchors(h, length, seed_words).seed).view(np.int64))
        return {"seed": np.concatenate(found)}

    counts = map_batches(sample.select("text"), lambda: work, "seed long").groupBy("seed").count()
    least = max(LEAST_HOT, int(min(HOT_SHARE, HOT_ROWS / max(1, n)) * min(n, wanted)))
    top = counts.filter(F.col("count") >= least).orderBy(F.desc("count"), "seed").limit(HOT_SEEDS).select("seed").collect()
    return np.sort(np.array([r["seed"] for r in top], np.int64))


def packed_place(first: np.ndarray, offset: np.ndarray, salt: np.ndarray, more: np.ndarray) -> np.ndarray:
    """First window (31 bits and more), offset of the anchor (24 bits), salt (7 bits); negative (less one) if there are more."""
    place = first << 31 | offset << 7 | salt
    return np.where(more, -1 - place, place)


def anchor_rows(texts: DataFrame, hot: np.ndarray, length: int, seed_words: int) -> DataFrame:
    """One row an anchor of every row of texts (doc_id, part, text), in few columns, as all of them are dealt. seed is that
    of the deal: of common seeds, one of SALTS; n is the number of windows; sides are the doubled parts of a level, behind and before,
    in 32 bits each."""
    names = [f"sides{size}" for size in levels(length, seed_words)]
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def work(batch):
        out = {k: [np.empty(0, np.int64)] for k in ("seed", "salt", "doc_id", "part", "first", "offset", "more", "n", "whole", *names)}
        for doc_id, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text")), strict=True):
            h = word_hashes(words(text))
            if len(h) < length:
                continue
            own = Anchors(h, length, seed_words)
            at, more = own.once()
            values = (own.seed[at].view(np.int64), np.full(len(at), 1 + (doc_id ^ part) % SALTS), np.full(len(at), doc_id, np.int64), np.full(len(at), part, np.int64), own.first[at], own.offset[at], more, own.count[at], own.whole[at].view(np.int64))
            for name, found in zip(out, values, strict=False):
                out[name].append(found)
            for name, behind, before in zip(names, own.parts[::2], own.parts[1::2], strict=True):
                out[name].append((behind[at] << 32 | before[at] & 0xFFFFFFFF))
        out = {k: np.concatenate(v) for k, v in out.items()}
        salt = out["salt"] * np.isin(out["seed"], shared.value)
        with np.errstate(over="ignore"):
            out["seed"] ^= salt * SALT_STEP
        out["place"] = packed_place(out["first"], out["offset"], salt, out["more"].astype(bool))
        return out

    schema = "seed long, doc_id long, part long, place long, n int, whole long"
    return map_batches(texts.select("doc_id", "part", "text"), lambda: work, ", ".join([schema, *(f"{x} long" for x in names)]), rows=500)


def repeated(*key: str) -> Column:
    """Whether the rows of a key are of several documents."""
    own = Window.partitionBy(*key)
    return F.min("doc_id").over(own) < F.max("doc_id").over(own)


def settled_or_open(texts: DataFrame, length: int, seed_words: int) -> DataFrame:
    """(doc_id, part, place, n, settled) of anchors: settled where an earlier document has the whole stretch, else open, to be compared
    window by window. Others repeat nothing of an earlier document."""
    sizes, hot = levels(length, seed_words), hot_seeds(texts, length, seed_words)
    place = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    rows = anchor_rows(texts, hot, length, seed_words).repartition("seed")
    rows = rows.withColumn("salt", place.bitwiseAND(127)).withColumn("offset", F.shiftright(place, 7).bitwiseAND((1 << 24) - 1))
    known = F.col("salt") > 0
    rows = rows.withColumn("goes_on", known | repeated("seed")).filter("goes_on")
    for size in sizes:
        sides = F.col(f"sides{size}")
        rows = rows.withColumn(f"r{size}", F.shiftright(sides, 32)).withColumn(f"l{size}", F.when(sides.bitwiseAND(1 << 31) == 0, sides.bitwiseAND((1 << 31) - 1)).otherwise(-1))
        passes = [(F.col(f"{side}{size}") >= 0) & (known | repeated("seed", f"{side}{size}")) for side in "rl"]
        rows = rows.withColumn(f"goes_on{size}", passes[0] | passes[1]).filter(f"goes_on{size}")
    # Of a kind, those with one stretch, only the first document is open; with salts, the first of each part.
    kind = ["whole", "n", "offset"]
    rows = rows.withColumn("first_id", F.min("doc_id").over(Window.partitionBy("seed", *kind)))
    opens = F.col("first_id") == F.col("doc_id")
    own = Window.partitionBy("seed")
    last = F.max(F.when(opens & (F.col("earliest") < F.col("doc_id")), F.col("doc_id"))).over(own)
    rows = rows.withColumn("earliest", F.min("doc_id").over(own)).withColumn("last_open", last)
    # What nobody before or behind can hold a part of is dropped.
    wanted = known | ~opens | (F.col("earliest") < F.col("doc_id")) | (F.col("doc_id") < F.col("last_open"))
    held = ["doc_id", "part", "place", "n"]
    rows = written(rows.filter(wanted).select(*held, (~opens).alias("settled"), *[F.when(known & opens, F.col(c)).alias(c) for c in ("seed", "salt", "whole", "offset")]), "substring-anchors")
    if not len(hot):
        return rows.select(*held, "settled")
    common = rows.filter("salt is not null").withColumn("seed", F.col("seed").bitwiseXOR(F.col("salt") * SALT_STEP)).drop("salt", "settled")
    firsts = written(common.groupBy("seed", *kind).agg(F.min("doc_id").alias("first_id")), "substring-firsts")
    seeds = written(firsts.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("seed"), "substring-mixed")
    common = common.join(firsts, ["seed", *kind]).withColumn("settled", F.col("first_id") < F.col("doc_id"))
    # Kinds that are alone with their seed have nothing to be compared with.
    alone = common.filter("settled").select(*held, "settled")
    mixed = common.filter("not settled").join(seeds, "seed", "left_semi").select(*held, "settled")
    return rows.filter("salt is null").select(*held, "settled").unionByName(alone).unionByName(mixed)


def packed_range(first: Column, n: Column, more: Column) -> Column:
    """Windows first to first + n - 1 in one number; negative (less one) if the document holds more like them."""
    packed = F.shiftleft(first.cast("long"), 16).bitwiseOR(n.cast("long"))
    return F.when(more, -1 - packed).otherwise(packed)


def covered_windows(texts: DataFrame, length: int, seed_words: int) -> DataFrame:
    """(doc_id, part, place) of ranges of windows (packed_range) that start in an earlier document too."""
    place = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    found = settled_or_open(texts, length, seed_words).withColumn("place", packed_range(F.shiftright(place, 31), F.col("n"), F.col("place") < 0)).drop("n")
    found = written(found, "substring-found")
    ranges = written(found.filter("not settled").groupBy("doc_id", "part").agg(F.collect_list("place").alias("places")), "substring-open")

    def work(batch):
        out = {k: [np.empty(0, np.int64)] for k in ("a", "b", "doc_id", "part", "place")}
        for doc_id, part, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text", "places")), strict=True):
            h = word_hashes(words(text))
            start, more = windows_of(places)
            values = (*(Ranges(h, base).get(start, start + length).view(np.int64) for base in (0, 1)), np.full(len(start), doc_id), np.full(len(start), part), np.where(more, -1 - (start << 16 | 1), start << 16 | 1))
            for name, x in zip(out, values, strict=True):
                out[name].append(x)
        return {k: np.concatenate(v) for k, v in out.items()}

    marked = maybe_in(texts, ranges, "doc_id").filter("maybe")
    opened = map_batches(marked.select("doc_id", "part", "text").join(ranges, ["doc_id", "part"]), lambda: work, "a long, b long, doc_id long, part long, place long", rows=500)
    opened = written(opened, "substring-windows")
    first = written(opened.groupBy("a", "b").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").drop("last_id"), "substring-first")
    single = opened.join(first, ["a", "b"]).filter("first_id < doc_id")
    return found.filter("settled").select("doc_id", "part", "place").unionByName(single.select("doc_id", "part", "place"))


def windows_of(places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of packed ranges, and whether the document holds more like each."""
    p = np.array(places)
    more = p < 0
    p = np.where(more, -1 - p, p)
    first, n = p >> 16, p & 0xFFFF
    each = np.repeat(np.arange(len(p)), n)
    return first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n), more[each]


def kept_words(parts: list[bytes], places: list[int] | None, length: int) -> list[bytes]:
    if not places:
        return parts
    edges = np.zeros(len(parts) + 1, np.int64)
    start, more = windows_of(places)
    marked = start[more]
    if len(marked):
        # All windows of the document that equal one in a marked place.
        own = Ranges(word_hashes(parts))
        every = np.arange(len(parts) - length + 1)
        hashes = own.get(every, every + length)
        start = np.union1d(start, every[np.isin(hashes, hashes[marked])])
    np.add.at(edges, start, 1)
    np.add.at(edges, start + length, -1)
    keep = (np.cumsum(edges[:-1]) == 0).tolist()
    return [w for w, k in zip(parts, keep, strict=True) if k]


def deduplicated(docs: DataFrame, *, length: int = LENGTH, seed_words: int = SEED_WORDS, texts_out: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of docs (doc_id, text); kept is the sha256 of the kept words
    joined by spaces, or with texts_out these words themselves."""
    if not 1 <= seed_words <= length < 1 << 16:
        raise ValueError("a window holds its seed, and has less than 65,536 words")
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    texts, part = docs.filter("doc_id is not null"), F.lit(0).cast("long")
    # Rows that repeat an id are told apart by their texts.
    again = written(texts.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("again")), "substring-again")
    if again.isEmpty():
        discard(again)
    else:
        texts, part = texts.join(again, "doc_id", "left"), F.when(F.col("again"), F.xxhash64("text")).otherwise(0)
    texts = texts.select("doc_id", "text", part.alias("part"))
    places = covered_windows(texts, length, seed_words).groupBy("doc_id", "part").agg(F.collect_set("place").alias("places"))
    without = docs.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("places"))

    def work(batch):
        n, removed, kept = [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
            parts = words(text)
            left = kept_words(parts, places, length)
            joined = b" ".join(left)
            n.append(len(parts))
            removed.append(len(parts) - len(left))
            kept.append(joined.decode("utf-8", "surrogatepass") if texts_out else hashlib.sha256(joined).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_words": n, "n_removed": removed, "kept": kept}

    # Texts whose ids surely have no place are not dealt.
    places = written(places, "substring-places")
    marked = maybe_in(texts, places, "doc_id")
    without = without.unionByName(marked.filter("not maybe").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("places")))
    joined = marked.filter("maybe").join(places, ["doc_id", "part"], "left").select("doc_id", "text", "places").unionByName(without)
    return map_batches(joined, lambda: work, "doc_id long, n_words long, n_removed long, kept string", rows=500)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir)).withColumnRenamed("kept", "kept_sha256")


OP6_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - {LENGTH - 2})) AS i, w FROM words WHERE len(w) >= {LENGTH}),
keyed AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {LENGTH - 1}), ' ') AS t FROM windows),
repeats AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first_id FROM keyed) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM repeats, range({LENGTH}) r(j)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""
