"""Learned operators against plain versions, and their edge cases."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import language_id, pii, quality, toxicity

rnd = random.Random(3)
MASK = (1 << 64) - 1


def plain_hash(gram):
    h = len(gram)
    for c in gram:
        h = (h * int(language_id.MIXES[0]) + ord(c)) & MASK
    h ^= h >> 29
    h = h * int(language_id.MIXES[1]) & MASK
    return h ^ h >> 32


def plain_prediction(model, text):
    """Counts of n-grams whose slots all have a language's bit, less false positives, one by one."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    kept = " " + " ".join(kept.split()) + " " if kept.split() else " "
    if len(kept) < 3:
        return "und", 0.0
    grams = [kept[i : i + n] for n in language_id.ORDERS for i in range(len(kept) - n + 1)]
    best = (0.0, None)
    for i, name in enumerate(model.languages):
        seen = sum(all(int(model.masks[i >> 6][(plain_hash(g) * int(language_id.MIXES[k % 4]) + k & MASK) >> 64 - language_id.SLOT_BITS]) >> (i & 63) & 1 for k in range(language_id.HASHES)) for g in grams)
        false = model.false_rate[i]
        corrected = (seen - len(grams) * false) / (1 - false)
        if corrected > best[0] + 1e-9:
            best = (corrected, name)
    return (model.usual, 0.0) if best[1] is None else (best[1], min(1.0, best[0] / len(grams)))


@pytest.fixture(scope="module")
def languages(spark):
    sets = {"aa": ["mor", "tal", "vin"], "bb": ["qua", "zeb", "jux"], "": ["été", "ñam", "öst"]}
    rows = [(i, " ".join("".join(rnd.choices(parts, k=2)) for _ in range(30)), lang) for k, (lang, parts) in enumerate(sets.items()) for i in range(40 * k, 40 * k + 40)]
    frame = spark.createDataFrame(rows + [(500, rows[0][1], "aa"), (501, None, "aa"), (502, "x", None)], "doc_id long, text string, lang string")
    return frame.selectExpr("*", "1 as place", "2 as slot", "3 as n", "4 as lang_pred"), language_id.fit(frame)


def test_language_equals_a_plain_version(languages):
    frame, model = languages
    assert model.languages == ["", "aa", "bb"] and model.usual == "aa"
    texts = [r["text"] for r in frame.filter("text is not null").collect()]
    for text in [*texts[::5], *(" ".join(rnd.choices(texts[3].split() + texts[50].split() + texts[90].split(), k=9)) for _ in range(30)), "a", "1 2", "Ünïcode été! mortal"]:
        want, got = plain_prediction(model, text), model.predict(text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9


def test_language_edges(spark, languages, monkeypatch):
    frame, model = languages
    assert model.predict("汉字 测试") == ("aa", 0.0) and model.predict("ქართული")[0] == "aa"
    assert [model.predict(t) for t in (None, "", " 12 !?")] == [("und", 0.0)] * 3
    long = " ".join(r["text"] for r in frame.filter("text is not null").collect())
    whole = model.predict(long)
    monkeypatch.setattr(language_id, "PART", 100)
    assert model.predict(long) == whole
    out = language_id.predicted(frame, model, "doc_id")
    assert out.count() == frame.count() and out.columns == ["doc_id", "lang_pred", "score"]
    assert language_id.predicted(frame.filter("false"), model, "doc_id").count() == 0


def test_expectation_maximisation_equals_a_plain_version():
    patterns = np.array([[1, 1, 0], [1, -1, 1], [-1, -1, 0], [0, 0, -1], [-1, 1, -1]])
    counts = np.array([40.0, 7, 25, 3, 9])
    p = [min(0.95, max(0.05, 0.5 + 0.5 * sum(v) / max(1, sum(map(abs, v))))) for v in patterns.tolist()]
    for _ in range(50):
        share = (sum(c * q for c, q in zip(counts, p)) + 1) / (sum(counts) + 2)
        odds = [math.log(share / (1 - share))] * len(p)
        for j in range(3):
            for v, prior in ((1, 0.8), (-1, 0.2)):
                a = (sum(c * q for c, q, w in zip(counts, p, patterns) if w[j] == v) + 10 * prior) / (sum(c * q for c, q, w in zip(counts, p, patterns) if w[j]) + 10)
                b = (sum(c * (1 - q) for c, q, w in zip(counts, p, patterns) if w[j] == v) + 10 * (1 - prior)) / (sum(c * (1 - q) for c, q, w in zip(counts, p, patterns) if w[j]) + 10)
                odds = [o + math.log(a / b) if w[j] == v else o for o, w in zip(odds, patterns)]
        p = [1 / (1 + math.exp(-o)) for o in odds]
    assert np.allclose(pii.reliabilities(patterns, counts)[0], p, atol=1e-4)


def test_span_classifier_uses_span_and_context(spark):
    rows = [(i, f"please call my phone (0{rnd.randint(10, 99)}) {rnd.randint(100, 999)} {rnd.randint(10, 99)} {rnd.randint(10, 99)} today") for i in range(60)]
    rows += [(100 + i, f"order no {rnd.randint(10, 99)} {rnd.randint(10, 99)} {rnd.randint(10, 99)} of the page") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.found_spans(frame)
    weights = pii.train(found)
    c = {r["doc_id"]: r["extra"][0] for r in found.collect()}
    p = {i: pii.probability(weights, x["kind"], x["votes"], x["slots"]) for i, x in c.items()}
    assert min(p[i] for i in range(60)) > 0.9 > 0.5 > max(p[100 + i] for i in range(60))
    # Votes alone do not decide: without span and context features probabilities change.
    assert any(abs(p[i] - pii.probability(weights, x["kind"], x["votes"], [])) > 1e-3 for i, x in c.items())
    again = frame.selectExpr("*", "1 as base", "2 as extra", "3 as spans", "4 as kind")
    got = {r["doc_id"]: len(r["spans"]) for r in pii.spans(again).collect()}
    assert all(got[i] == 1 for i in range(60)) and not any(got[100 + i] for i in range(60))
    assert pii.masked_text(again).columns == again.columns and pii.masked_text(again.filter("false")).count() == 0


def test_many_candidates_in_one_text_and_long_addresses():
    text = "(030) 123 45 67 " * 100_000
    began = time.time()
    assert len(pii.extra_candidates(text, pii.base_spans(text))) == 100_000 and time.time() - began < 5
    long = "a" * 300 + " [at] " + "b" * 200 + " [dot] " + " [dot] ".join("cdefghij")
    assert pii.extra_candidates(long, []) == [(0, len(long), "email")]
    assert pii.extra_candidates("(030) 123 45 67", [(3, 8, "ip")]) == []


def test_ordinal_likelihood_is_at_its_maximum():
    r = np.random.default_rng(1)
    grade = r.integers(0, 3, 300)
    index, value = np.where(r.random(300) < 0.2 + 0.3 * grade, 1, 2), np.ones(300)
    model = quality.train(index, value, np.arange(301), grade, bits=3, rounds=1500, ridge=0.0, rate=0.02)

    def loss(weights, thresholds):
        total = 0.0
        for i, g in zip(index, grade):
            tails = [1.0] + [1 / (1 + math.exp(t - weights[i])) for t in thresholds] + [0.0]
            total -= math.log(tails[g] - tails[g + 1])
        return total / len(grade)

    w, t = model.weights.astype(float), model.thresholds
    best = loss(w, t)
    for step in (0.05, -0.05):
        for k in range(2):
            assert loss(w, t + step * (np.arange(2) == k)) > best - 1e-4
        assert loss(w + step * (np.arange(8) == 1), t) > best - 1e-4


def test_quality_and_toxicity_edges(spark):
    rows = [(i, ("good words here " if i % 2 else "BAD!! idiotic ") * 5) for i in range(80)] + [(200, "BAD!! idiotic " * 30_000), (201, None), (1, "BAD!! idiotic")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxic", "3 as grade", "4 as half", "5 as x", "6 as term")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(80)], "doc_id long, toxic int, grade int")
    found = toxicity.scored(frame, toxicity.fit(frame, labels.select("doc_id", "toxic")))
    assert found.count() == len(rows) and {r["doc_id"] for r in found.filter("score >= 0.5").collect()} >= {*range(0, 80, 2), 200}
    graded = quality.graded(frame, quality.fit(frame, labels.select("doc_id", "grade"), rounds=60))
    assert graded.count() == len(rows) and graded.filter("doc_id = 200").first()["expected_grade"] < 0.5
    first = [toxicity.fit(frame, labels.select("doc_id", "toxic"))[1].tolist() for _ in range(2)]
    assert first[0] == first[1]


TERMS = [("idiot", False, 2.0), ("worthless", False, 3.0), ("so", False, 1.0), ("x" * 45, False, 1.5)]


@pytest.mark.parametrize(("word", "term", "edits"), [("idiooooot", 0, 1), ("1d10t", 0, 1), ("worthles", 1, 1), ("worhtless", 1, 2), ("so", 2, 0), ("x" * 45, 3, 0), ("x" * 44, None, 0), ("idxxt", None, 0), ("s0", None, 0), ("w0rthle55", 1, 1)])
def test_words_of_all_lengths_and_misspellings(word, term, edits):
    got = toxicity.Matcher(TERMS).match(word)
    if word == "x" * 44:
        assert got == (3, 1)
    elif word == "s0":
        assert got == (2, 1)
    else:
        assert got == (None if term is None else (term, edits))


def test_two_edits_against_dynamic_programming():
    matcher = toxicity.Matcher(TERMS[:2])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for _ in range(4000):
        word = list(rnd.choice(["idiot", "worthless"]))
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(word) + 1)
            word[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "t", "s"])
        word = "".join(word)
        near = [d for d, limit in ((distance(word, "idiot"), 1), (distance(word, "worthless"), 2)) if d <= limit]
        got = matcher._match(word)
        assert (got is not None) == bool(near) and (not got or got[1] == min(near)), word


def test_score_is_the_logistic_of_the_features():
    weights = np.array([-2.0, 1.0, 0.5, 0.25, 0.1, -1.0, 0.3, 0.7])
    own = toxicity.Scorer(TERMS, weights)
    # Two exact hits of different terms and one misspelt, no quotes, one word of address in each window.
    text = "you idiot are so worthles today"
    n, words = 3, 6
    x = [1, math.log1p(3.0), 0.0, math.log1p(3.0), math.log1p(3), 0.0, math.log1p(1000 * n / (words + 20)), 1.0]
    assert np.allclose(own.features(text), x)
    assert abs(own.score(text) - 1 / (1 + math.exp(-float(np.dot(weights, x))))) < 1e-12
    quoted = own.features('they said "idiot" again')
    assert abs(quoted[5] - 1.0) < 1e-12 and own.score("clean") == own.score(None) == own.score("")
