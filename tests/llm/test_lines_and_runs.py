"""Line rules and periodic runs: against brute force and SQL, with odd rows."""

import hashlib
import os
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from paperloom.llm import line_quality as Q
from paperloom.llm import periodic_runs as P

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q) and not any(all(x[k] == x[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def shapes(rnd, kind):
    n = rnd.randint(0, 60)
    if kind < 2:
        return [rnd.randint(0, kind + 1) for _ in range(n)]
    if kind == 2:
        out = []
        while len(out) < n + 40:
            w = [rnd.randint(0, 3) for _ in range(rnd.randint(1, 9))]
            out += w * rnd.randint(1, 7) + w[: rnd.randint(0, len(w))]
        return out
    w = [rnd.randint(0, 1) for _ in range(rnd.randint(1, 5))]
    return (w * rnd.randint(1, 5) + [rnd.randint(0, 2)]) * rnd.randint(1, 8) + w * rnd.randint(0, 5)


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    for t in range(2000):
        x = shapes(rnd, t % 4)
        assert P.runs_of(np.array(x, np.int64)) == brute_runs(x), x


def test_work_stays_near_the_length():
    """Uniform, nested and periodic texts: the pairs of blocks that are extended are few."""
    long = np.tile(np.random.default_rng(0).integers(0, 50, 777), 20)
    assert P.runs_of(long) == [(0, len(long), 777)]
    assert P.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    for size in (1, 16, 1024):
        start, distance = P.seeds(np.zeros(20_000, np.int64), size)
        assert len(start) <= 20_000 and distance.min() >= size and distance.max() < 2 * size


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b " * 40), (4, "a b " * 40), (None, "x " * 30), (None, None), (5, "word " * 20_000), (6, "é x  ü\x1c y " * 9), (7, "a\x00b c " * 6)]
ODD += [(i, " ".join(random.Random(i).choice("pqr") for _ in range(30))) for i in range(100, 140)]


def test_runs_of_odd_rows(spark):
    frame = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 as runs", "2 as n_words", "3 as start")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["text"]) for r in P.detected(frame, planted=True).collect())
    want = []
    for i, text in ODD:
        w = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            a, g = (h // 10) % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = [(0, len(w), 1)] if i == 5 else brute_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((-1 if i is None else i, len(w), tuple(runs), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert got == sorted(want)
    assert P.detected(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="repeats its period"):
        P.detected(frame, power=1)


def test_best_run_compares_exactly():
    runs = [(0, 10**18 + 1, 10**17), (5, 10**18 + 2, 10**17), (9, 2 * 10**18 + 4, 2 * 10**17)]
    assert P.best_run(runs) == runs[1] and P.best_run([]) is None
    assert Fraction(runs[1][1], runs[1][2]) == Fraction(runs[2][1], runs[2][2])


def test_every_rule_of_lines(spark):
    good = "Some plain sentence of quite ordinary words that ends as one should, without any marks at all."
    lines = {
        "buy *** now $$$ here ### !!!": "punctuation", "Products and news": "open_end", "home • news • about us.": "navigation",
        "THIS IS ALL WRITTEN IN CAPITALS HERE.": "shouting", "All Rights Reserved by us.": "boilerplate", good: None, f"{good} ": None,
    }
    text = "\n".join([*lines, "", " \t", good])
    assert [(line, rule) for line, _, rule in Q.lines_of(text)] == [*lines.items(), (good, "repeated")]
    long = "w " * 40
    assert Q.failed_rule(long, long.encode().split()) is None
    row = Q.cleaned(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert row["text"] == f"{good}\n{good} " and row["n_dup_lines"] == 1 and row["failed_lines"] == [x for x in lines.values() if x] + ["repeated"]


def test_repeat_words_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        x, window = shapes(rnd, rnd.randint(0, 3)), rnd.randint(1, 9)
        seen = [tuple(x[i : i + window]) for i in range(len(x) - window + 1)]
        want = {i + k for i, s in enumerate(seen) if seen.count(s) > 1 for k in range(window)}
        assert Q.repeat_words(np.array(x, np.int64), window) == len(want)


def _values(rows, columns):
    return sorted(tuple("null" if r[c] is None else f"{r[c]}" for c in columns) for r in rows)


@pytest.mark.parametrize(("op", "sql"), [(Q.op12_line_quality, Q.OP12_SQL), (P.op13_periodic_runs, P.OP13_SQL)])
@pytest.mark.parametrize("odd", [False, True])
def test_queries_equal_their_sql(spark, tmp_path, op, sql, odd):
    if odd:
        # Rows with one id cannot be told apart in the SQL of the runs.
        rows = [(i, t) for k, (i, t) in enumerate(ODD) if i is not None and i not in {x for x, _ in ODD[:k]} and i != 7]
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    elif not os.path.isdir(DATA):
        pytest.skip("no test tables")
    folder, files = (tmp_path, "/*.parquet") if odd else (DATA, "")
    got = op(spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{files}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    columns = sorted(got.columns)
    assert sorted(names) == columns
    assert _values(got.collect(), columns) == _values([dict(zip(names, r, strict=True)) for r in found.fetchall()], columns)


def test_digests_of_no_words():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
    assert P.collapsed([], []) == [] and P.replaced([], 1) == []
