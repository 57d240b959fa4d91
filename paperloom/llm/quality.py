"""Quality by ordinal regression with cumulative logits.

A text is the mean of hashed features of its words (the word, and its shape: case, digits, marks) and a few hashed features
of the whole (shares of repeated words and lines, lengths). One weight a slot is shared by all grades; ordered thresholds
divide the score, P(grade <= k) = logistic(threshold k - score), which gives the expected grade and the probability of a
grade or better, by which documents are selected.

The model is fitted on about train_rows rated rows, chosen by a hash of the id, with their sparse features on the driver;
texts are scored whole. Grades are whole numbers from 0; null grades and null texts are not learned, of repeated ratings of
a document the largest counts. Null and empty texts get the score of a text without words; if fewer than two grades are
rated every document gets expected grade 0 and probability 0. Repeated rows give a row each and very long texts are read
whole; an empty table gives no rows; further columns are ignored. Of labels, quality null is no rating, and toxic null counts as
not toxic.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import documents, fold, map_batches
from paperloom.llm.toxicity import scorer
from paperloom.scratch import discard, written

TRAIN_ROWS = 12_000  #: rated rows to fit on, about
SLOT_BITS = 18
ROUNDS = 200
CACHE_WORDS = 300_000
MARKS = re.compile(r"[^\w\s]+")


def slot(feature: str, bits: int = SLOT_BITS) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) >> (32 - bits)


def shape(word: str) -> str:
    """Case, digits and the marks of a word, runs as one."""
    case = "U" if word.isupper() else "l" if word.islower() else "T" if word[:1].isupper() else "m"
    digits = "9" if any("0" <= c <= "9" for c in word) else ""
    return f"{case}{digits}{''.join(MARKS.findall(word))}{'+' if len(word) > 14 else ''}"


def word_slots(word: str) -> tuple[int, int]:
    core = MARKS.sub("", word.lower())
    return slot("w " + core), slot("s " + shape(word))


def whole_slots(text: str, words: list[str]) -> list[int]:
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda a, b: int(10 * a / b) if b else 0
    return [
        slot(f"n {int(math.log2(n + 1))}"),
        slot(f"u {share(len(set(words)), n)}"),
        slot(f"l {share(len(set(lines)), len(lines))}"),
        slot(f"c {min(20, len(text) // n if n else 0)}"),
        slot(f"b {share(len(set(zip(words, words[1:], strict=False))), n - 1 if n > 1 else 1)}"),
    ]


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Slots and values: means over words, and 0.2 for each feature of the whole."""
    words = (text or "").split()
    out: dict[int, float] = {}
    for w in words:
        for s in word_slots(w):
            out[s] = out.get(s, 0.0) + 1.0 / len(words)
    for s in whole_slots(text or "", words):
        out[s] = out.get(s, 0.0) + 0.2
    return list(out), list(out.values())


class OrdinalModel:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.seen: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        a, b = word_slots(word)
        found = float(self.weights[a] + self.weights[b])
        if len(word) < 40:
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            self.seen[word] = found
        return found

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        get, weight = self.seen.get, self._weight
        total = 0.0
        for w in words:
            x = get(w)
            total += weight(w) if x is None else x
        return total / max(1, len(words)) + 0.2 * float(sum(self.weights[s] for s in whole_slots(text or "", words)))

    def grades(self, score: float) -> tuple[float, list[float]]:
        """Expected grade and the probabilities of grade 1 or better, 2 or better, and so on."""
        tails = [1 / (1 + math.exp(min(40.0, max(-40.0, t - score)))) for t in self.thresholds]
        return sum(tails), tails


def train(index: np.ndarray, value: np.ndarray, start: np.ndarray, grade: np.ndarray, bits: int = SLOT_BITS, rounds: int = ROUNDS, ridge: float = 1e-4, rate: float = 0.3) -> OrdinalModel:
    """Maximum likelihood by Adam on all rows at once. Rows are start[i]:start[i + 1] of index and value."""
    k = int(grade.max())
    lengths, rows = np.diff(start), len(grade)
    shares = np.array([(grade <= j).mean() for j in range(k)]).clip(0.01, 0.99)
    logits = np.log(shares / (1 - shares))
    # Thresholds are the first and the logarithms of the steps to the others, so they stay in order.
    params = [np.zeros(1 << bits), np.concatenate((logits[:1], np.log(np.maximum(0.05, np.diff(logits)))))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def thresholds(t: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate((t[:1], np.exp(t[1:]))))

    for step in range(1, rounds + 1):
        s = np.add.reduceat(params[0][index] * value, start[:-1])
        theta = thresholds(params[1])
        edges = np.concatenate(([-np.inf], theta, [np.inf]))
        upper, lower = sigmoid(edges[grade + 1] - s), sigmoid(edges[grade] - s)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        ds = (du - dl) / rows
        g_w = np.bincount(index, value * np.repeat(ds, lengths), minlength=1 << bits) + ridge * params[0] / 10
        g_theta = np.array([(-du[grade == j].sum() + dl[grade == j + 1].sum()) / rows for j in range(k)])
        g_t = np.concatenate(([g_theta.sum()], [g_theta[j:].sum() * np.exp(params[1][j]) for j in range(1, k)]))
        for i, g in enumerate((g_w, g_t)):
            m, v = moments[i]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            params[i] = params[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(params[0].astype(np.float32), thresholds(params[1]))


def fit(docs: DataFrame, ratings: DataFrame, *, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> OrdinalModel | None:
    """docs (doc_id, text), ratings (doc_id, grade)."""
    rated = ratings.filter("grade >= 0 and doc_id is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    n = rated.count()
    share = min(1.0, train_rows / n) if n else 0.0
    chosen = rated.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = written(docs.filter("text is not null").select("doc_id", "text").join(chosen, "doc_id"), "quality-sample")

    def work(batch):
        made = [features(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "i": [m[0] for m in made], "v": [m[1] for m in made]}

    rows = map_batches(sample.selectExpr("cast(doc_id as long) doc_id", "text", "grade"), lambda: work, "doc_id long, grade int, i array<int>, v array<float>")
    table = rows.toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    discard(sample)
    if table.num_rows == 0 or len(set(table["grade"].to_pylist())) < 2:
        return None
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in table[c].chunks])
    lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in table["i"].chunks])
    return train(flat("i"), flat("v").astype(np.float64), np.concatenate(([0], np.cumsum(lengths))), table["grade"].to_numpy(), rounds=rounds)


def graded(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """(doc_id, expected_grade, tails) of every row of docs (doc_id, text); tails: P(grade >= 1), P(grade >= 2), …"""
    shared, name = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.weights, model.thresholds)), uuid.uuid4().hex

    def make():
        own = scorer(name, lambda: OrdinalModel(*shared.value)) if shared.value is not None else None

        def work(batch):
            got = [own.grades(own.score(t)) if own else (0.0, [0.0]) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "expected_grade": [g[0] for g in got], "tails": [g[1] for g in got]}

        return work

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, "doc_id long, expected_grade double, tails array<double>")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: 0 poor, 1 good but toxic, 2 good. score is the probability of grade 1 or better."""
    docs, held_out = documents(spark, sf_dir), fold(F.col("doc_id")) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out).filter("quality in (0, 1)")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    found = graded(docs, fit(docs, labels.select("doc_id", grade.alias("grade"))))
    score = F.get("tails", F.lit(0))
    return found.select("doc_id", held_out.alias("held_out"), "expected_grade", score.alias("score"), F.coalesce(F.get("tails", F.lit(1)), F.lit(0.0)).alias("tail_2"), (score >= 0.5).cast("int").alias("predicted"))
