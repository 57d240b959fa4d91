"""Substring removal against brute force: repeated ids, long repeats, common passages, other window lengths."""

import hashlib
import random

import numpy as np
import pytest

from paperloom.llm import substring_dedup as S

WORDS = [f"{a}{b}" for a in "abcdef" for b in "xyz"]


def brute(rows, length):
    first, want = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {j for k in range(len(w) - length + 1) if i is not None and first[tuple(w[k : k + length])] < i for j in range(k, k + length)}
        want.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(want)


def rows():
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    common, long = text(60), text(900)
    out = [(i, f"{text(rnd.randint(0, 30))} {common} {text(rnd.randint(0, 30))}") for i in range(60)]
    # Parts of a long passage, cut at any word, and documents that repeat within themselves.
    parts = long.split()
    for i in range(100, 140):
        a = rnd.randrange(800)
        out.append((i, text(rnd.randint(0, 8)) + " " + " ".join(parts[a : a + rnd.randint(5, 100)]) + " " + text(5)))
    out += [(200, long), (90, (text(15) + " ") * 12), (201, out[-1][1] * 3), (202, None), (203, ""), (204, "a b c"), (None, long), (None, None)]
    # One id with several texts and repeated rows.
    mine, other = text(40), text(40)
    out += [(300, mine), (301, mine), (301, other), (301, mine), (302, other), (302, other)]
    return out


@pytest.mark.parametrize(("length", "seed_words", "hot"), [(13, 4, True), (13, 4, False), (5, 2, True), (50, 4, False), (4, 4, False), (7, 1, True)])
def test_equals_brute_force(spark, monkeypatch, length, seed_words, hot):
    monkeypatch.setattr(S, "LEAST_HOT", 5 if hot else 10**9)
    docs = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 as seed", "2 as part", "3 as place")
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in S.deduplicated(docs, length=length, seed_words=seed_words).collect()]
    assert sorted(got) == brute(rows(), length)


def test_levels_double():
    assert S.levels(13, 4) == [8] and S.levels(50, 4) == [8, 16] and S.levels(100, 4) == [8, 16, 32] and S.levels(4, 4) == []


def test_windows_that_share_their_beginning_are_told_apart(spark):
    """Two windows of 13 words that share eight words, their anchor and 32 bits of their hash are different all the same."""
    rng, n = np.random.default_rng(3), 400_000
    # A beginning that holds the least hash of four words of nearly every window.
    at = np.arange(5)
    start = next(w for w in ([f"s{k}x{i}".encode() for i in range(8)] for k in range(10_000)) if S.Ranges(S.word_hashes(w)).get(at, at + 4).min() < 1 << 57)
    pool = [f"w{i}".encode() for i in range(3000)]
    h = np.concatenate((np.tile(S.word_hashes(start), (n, 1)), S.word_hashes(pool)[chosen := rng.integers(0, len(pool), (n, 5))]), axis=1)
    power, _ = S.Ranges._tables(1, 14)
    with np.errstate(over="ignore"):
        x = (h * power[:13]).sum(axis=1, dtype=np.uint64)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
    high = (x >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(high, kind="stable")
    pairs = [(int(a), int(b)) for a, b in zip(order, order[1:], strict=False) if high[a] == high[b] and (chosen[a] != chosen[b]).any()]
    texts = [[(b" ".join(start + [pool[k] for k in chosen[i]])).decode() for i in pair] for pair in pairs]
    # Those whose anchor is within the shared words are what one key for windows of 32 bits took for equal.
    alike = [(a, b) for a, b in texts if S.Anchors(S.word_hashes(S.words(a)), 13, 4).offset[0] == S.Anchors(S.word_hashes(S.words(b)), 13, 4).offset[0] <= 4]
    assert alike
    rows = [(2 * k + i, t) for k, pair in enumerate(alike) for i, t in enumerate(pair)]
    assert {r["n_removed"] for r in S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_query_equals_sql(spark):
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = con.execute(S.OP6_SQL)
    names = [c[0] for c in found.description]
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in S.op6_substring_dedup(spark, folder).collect()) == want
