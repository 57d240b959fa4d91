"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in each slot, one bit a language, 64 languages a word. An n-gram is looked up at several hashed
slots; their AND is the set of all languages that may contain it. A text's score for a language is the
number of its n-grams with that language's bit, less the false positives expected from the share of that
language's bits that are set. The language with the highest corrected count is predicted.

Training reads a bounded number of labelled rows (train_rows, chosen by a hash of the id) and counts their
n-grams in hashed counters on the executors; the driver gets the filter alone, of 2**slot_bits words for 64 languages.
A language's bit is inserted for n-grams that are not rare in it compared to the language where they are
most frequent.

Null texts, empty texts and texts without a letter are `und` with score 0. A text with letters none of whose n-grams
is known gets the most frequent label, with score 0. Ties go to the language that comes first by name. Null labels are not
learned; every other one is, the empty one too, however many there are. Without any label every text is `und`. Repeated rows
count as rows; an empty table gives no rows. Texts of any length are read whole. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import documents, fold, map_batches
from paperloom.scratch import discard, written

TRAIN_ROWS = 6_000  #: labelled rows to fit on, about
LEAST_ROWS = 50  #: rows of each language to fit on, about, where there are so many
SLOT_BITS = 20
MOST_WORDS = 16  #: words of 64 labels a filter holds with all its slots: 128 MB, for 1,024 labels
HASHES = 2
PART = 1 << 20  #: characters looked up at once
ORDERS = (2, 4)  #: lengths of the n-grams in characters, word borders included
SHARE = 0.2  #: least frequency of an n-gram in a language, as a part of its largest
MIXES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def letters(text: str) -> np.ndarray:
    """Lower-cased code points in which every run of other characters than letters is one space."""
    lowered = text.lower()
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ascii_letter = (points >= 97) & (points <= 122)
    is_letter = ascii_letter.copy()
    beyond = np.flatnonzero(points >= 128)
    if beyond.size:
        kinds, at = np.unique(points[beyond], return_inverse=True)
        is_letter[beyond] = np.array([chr(k).isalpha() for k in kinds])[at]
    points = np.where(is_letter, points, 32)
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    blank = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return points[keep]


def ngram_hashes(points: np.ndarray, orders=ORDERS) -> np.ndarray:
    """64-bit hashes of all n-grams that are more than a space."""
    found = []
    with np.errstate(over="ignore"):
        for n in orders:
            m = len(points) - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n))
            for k in range(n):
                h = h * MIXES[0] + points[k : k + m]
            h ^= h >> np.uint64(29)
            h *= MIXES[1]
            h ^= h >> np.uint64(32)
            found.append(h)
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def slots(h: np.ndarray, k: int, bits: int = SLOT_BITS) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * MIXES[k % 4] + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)


class Filter:
    """masks: for each 64 languages, uint64 a slot with a bit a language; filled: share of slots with each bit;
    usual: the label of texts that hold no known n-gram."""

    def __init__(self, languages: list[str], masks: np.ndarray, usual: str = "und"):
        self.languages, self.masks, self.usual = languages, masks, usual
        self.filled = np.array([np.count_nonzero(masks[i >> 6] >> np.uint64(i & 63) & np.uint64(1)) / masks.shape[1] for i in range(len(languages))])
        self.false_rate = self.filled**HASHES

    @property
    def slot_bits(self) -> int:
        return self.masks.shape[1].bit_length() - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return "und", 0.0
        points = letters(text)
        if len(points) < 3:
            return "und", 0.0
        counts, total = np.zeros(len(self.languages)), 0
        for at in range(0, len(points), PART):  # very long texts by parts: n-grams that start in each
            h = np.concatenate([ngram_hashes(points[at : at + PART + n - 1], (n,)) for n in ORDERS])
            at_slots = [slots(h, k, self.slot_bits) for k in range(HASHES)]
            for first in range(0, len(self.languages), 64):
                masks, n = self.masks[first >> 6], min(64, len(self.languages) - first)
                got = masks[at_slots[0]]
                for x in at_slots[1:]:
                    got = got & masks[x]
                seen = np.bincount(got, minlength=1 << n) if n <= 12 else None
                for i in range(n):
                    if seen is not None:
                        counts[first + i] += seen[np.arange(len(seen)) >> i & 1 == 1].sum()
                    else:
                        counts[first + i] += np.count_nonzero(got >> np.uint64(i) & np.uint64(1))
            total += len(h)
        corrected = np.maximum(0.0, (counts - total * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))
        best = int(np.argmax(corrected))
        if corrected[best] <= 0:
            return self.usual, 0.0
        return self.languages[best], float(min(1.0, corrected[best] / total))


def fit(labelled: DataFrame, *, train_rows: int = TRAIN_ROWS, slot_bits: int = SLOT_BITS) -> Filter:
    """Fit on labelled (doc_id, text, lang). Every label is learned; the filter, which is broadcast, has at most MOST_WORDS words of all
    its slots, so with more labels than that holds it has fewer slots a label, and is coarser."""
    labelled = labelled.filter("lang is not null and text is not null").select(F.col("doc_id"), F.col("text"), F.col("lang"))
    by_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(by_lang)
    usual = max(languages, key=by_lang.get, default="und")
    if not languages:
        return Filter([], np.zeros((1, 1 << slot_bits), np.uint64))
    # As many rows of each language, by a hash of the id.
    each = max(LEAST_ROWS, train_rows // len(languages))
    sampled = [min(by_lang[x], each) for x in languages]
    known = [(x, i, n, min(1.0, each / by_lang[x]), min(2, max(1, n // 20))) for i, (x, n) in enumerate(zip(languages, sampled, strict=True))]
    known = labelled.sparkSession.createDataFrame(known, "lang string, place int, sampled long, share double, least long")
    sample = labelled.join(F.broadcast(known.select("lang", "place", "share")), "lang")
    sample = sample.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("text", "place")
    words = -(-len(languages) // 64)
    slot_bits = max(6, slot_bits - (-(-words // MOST_WORDS) - 1).bit_length())
    size = 1 << slot_bits

    def counted(batch) -> dict:
        found = [np.empty(0, np.int64)]
        for text, place in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist(), strict=True):
            found.append(np.unique(slots(ngram_hashes(letters(text)), 0, slot_bits)) + place * size)
        at, n = np.unique(np.concatenate(found), return_counts=True)
        return {"place": (at // size).astype(np.int32), "slot": (at % size).astype(np.int32), "n": n}

    # Documents that have an n-gram, by its first slot.
    counts = map_batches(sample, lambda: counted, "place int, slot int, n long").groupBy("place", "slot").agg(F.sum("n").alias("n"))
    shares = written(counts.join(F.broadcast(known.select("place", "sampled", "least")), "place").withColumn("part", F.col("n") / F.col("sampled")), "language-shares")
    largest = shares.groupBy("slot").agg(F.max("part").alias("largest"))
    wanted = shares.join(largest, "slot").filter((F.col("part") >= SHARE * F.col("largest")) & (F.col("n") >= F.col("least")))
    bits = F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("bits")
    wanted_masks = _masks(wanted.groupBy(F.expr("cast(place div 64 as int)").alias("word"), "slot").agg(bits), words, size)
    discard(shares)

    # A second pass over the sample inserts the wanted n-grams at their further slots.
    shared = labelled.sparkSession.sparkContext.broadcast(wanted_masks)

    def inserted(batch) -> dict:
        hashes = [np.unique(ngram_hashes(letters(text))) for text in batch.column("text").to_pylist()]
        out = {"word": [], "slot": [], "bits": []}
        for word in range(words):
            masks = np.zeros(size, np.uint64)
            for h in hashes:
                bits = shared.value[word][slots(h, 0, slot_bits)]
                h, bits = h[bits > 0], bits[bits > 0]
                for k in range(HASHES):
                    np.bitwise_or.at(masks, slots(h, k, slot_bits), bits)
            at = np.flatnonzero(masks)
            for name, values in (("word", np.full(len(at), word, np.int32)), ("slot", at.astype(np.int32)), ("bits", masks[at].view(np.int64))):
                out[name].append(values)
        return {name: np.concatenate(parts) for name, parts in out.items()}

    table = map_batches(sample, lambda: inserted, "word int, slot int, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits"))
    return Filter(languages, _masks(table, words, size), usual)


def _masks(table: DataFrame, words: int, size: int) -> np.ndarray:
    """The filter of the rows (word, slot, bits)."""
    table = table.select("word", "slot", "bits").toArrow()
    masks = np.zeros((words, size), np.uint64)
    masks[table["word"].to_numpy(), table["slot"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return masks


def predicted(docs: DataFrame, model: Filter, *columns: str) -> DataFrame:
    """(columns..., lang_pred, score) of every row of docs, which has text and columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks, model.usual))

    def make():
        own = Filter(*shared.value)

        def work(batch):
            got = [own.predict(t) for t in batch.column("text").to_pylist()]
            return {c: batch.column(c) for c in columns} | {"lang_pred": [x[0] for x in got], "score": [x[1] for x in got]}

        return work

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "lang_pred string", "score double"])
    return map_batches(docs.select("text", *[c for c in columns if c != "text"]), make, schema, rows=500)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id")) == 0
    model = fit(docs.filter(~held_out))
    return predicted(docs.select("doc_id", "text"), model, "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
