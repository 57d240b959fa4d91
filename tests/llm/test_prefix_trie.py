"""Conversation tries against brute force and SQL, over many ranges, runs and levels."""

import hashlib
import os
import random
import tempfile
import zlib

import duckdb
import pyarrow as pa
import pytest

from paperloom.llm import prefix_trie as T

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest(), (r, t)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (0, 0) if p in kids else (1, 0)
        for k in kids.get(p, []):
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved + (len(members[p]) - 1) * (len(p[-1][1].encode().split()) if p else 0)

    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rnd = random.Random(7)
    out = []
    for c in range(0, 700):
        n = rnd.choice((1, 1, 2, 3, 5, 8))
        # Few different turns, so that paths branch at all depths, and a third of all conversations is one.
        turns = ["hello there", "what is it", "a b c"] if c % 3 == 0 else [rnd.choice(("x", "y z", "", None)) for _ in range(n)]
        out += [(c, t, rnd.choice(("user", "user", None)) if c % 3 else "user", text) for t, text in enumerate(turns)]
    long = [(2001, t, "user", f"turn {t}") for t in range(60)]
    out += long + [(2003, t, r, x) for _, t, r, x in long[:40]] + [(2005, t, r, x) for _, t, r, x in [*long[:50], (0, 50, "user", "other")]]
    # Ties, repeated rows, null turns and ids, ids below zero, one without a base.
    out += [(3000, 1, "a", "p"), (3000, 1, "a", "p"), (3000, 1, "b", "q"), (3000, None, "z", "z"), (None, 1, "a", "p"), (-5, 0, "user", "x"), (-20, 0, "user", "y"), (5001, 0, None, None)]
    rnd.shuffle(out)
    return out


def trie(spark, frame, **options):
    return T.trie(T.paths(T.rebuilt(T.turns(frame))), **options)


@pytest.mark.parametrize(("parts", "options"), [(3, {}), (24, {"run_rows": 7, "fan": 3}), (24, {"run_rows": 2, "fan": 2})])
def test_equals_brute_force(spark, parts, options):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 as part", "2 as path", "3 as depth", "4 as words")
        got = sorted((tuple(r[c] for c in COLUMNS) for r in trie(spark, frame, **options).collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows())


def test_empty_table_and_one_without_turns(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert trie(spark, frame).count() == 0
    # A conversation whose turns are all before h and whose base is absent.
    c = next(i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 4 == 3)
    got = trie(spark, spark.createDataFrame([(c, 0, "user", "x")], SCHEMA)).collect()
    assert [tuple(r[x] for x in COLUMNS) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_merge_gives_order_and_common_prefixes():
    rnd = random.Random(1)
    made = [(b"".join(bytes([rnd.randint(0, 2)]) * T.DIGEST for _ in range(rnd.randint(0, 6))), i, [1]) for i in range(500)]
    for run_rows in (1, 3, 50, 1000):
        batch = pa.RecordBatch.from_pydict({"path": [r[0] for r in made], "conv_id": [r[1] for r in made], "words": [r[2] for r in made]})
        with tempfile.TemporaryFile() as spool:
            got = list(T.merged(T.sorted_runs(iter([batch]), spool, run_rows)))
        assert [r[1:3] for r in got] == sorted(r[:2] for r in made)
        assert [r[0] for r in got] == [T.shared_turns(a[1] if a else b"", b[1], 0) for a, b in zip([None, *got], got, strict=False)]


def test_query_equals_sql(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in T.op11_prefix_trie(spark, DATA).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    found = con.execute(T.OP11_SQL)
    names = [c[0] for c in found.description]
    assert got == sorted((tuple(dict(zip(names, r, strict=True))[c] for c in COLUMNS) for r in found.fetchall()), key=str)
