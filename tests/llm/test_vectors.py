"""Vectors: recall at the threshold, extreme magnitudes, repeated ids, columns of other names."""

import numpy as np

from paperloom.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<double>, label int"


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    n, dim = 3000, 48
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((n, dim))
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.9801, 0.981, n)[:, None]
    y = c * x + np.sqrt(1 - c * c) * side
    rows = [(2 * i, x[i].tolist(), 1) for i in range(n)] + [(2 * i + 1, y[i].tolist(), 1) for i in range(n)]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).filter("n_links = 1 and vec_id % 2 = 1 and component_id = vec_id - 1").count()
    assert got >= 0.99 * n


def test_extreme_magnitudes_and_repeated_ids(spark):
    v = np.arange(1.0, 17.0)
    w = v.copy()
    w[0] += 0.5
    rows = [(1, (v * 1e200).tolist(), 1), (2, (w * 1e200).tolist(), 1), (3, (v * 1e-200).tolist(), 2), (4, (w * 1e-200).tolist(), 2), (5, (v * 1e-310).tolist(), 3), (6, w.tolist(), 3), (7, (-v).tolist(), 3)]
    rows += [(8, v.tolist(), 4), (8, v.tolist(), 4), (8, [0.0] * 16, 4)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as u", "2 as v", "3 as n", "4 as digest", "5 as rep", "6 as t", "7 as component")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_duplicates(frame).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 0, 8), (8, 1, 8), (8, 1, 8)]


def test_keys_grow_slowly_with_the_rows():
    assert E.key_sizes(1000)[1] == 8
    sizes = [E.key_sizes(10**k) for k in range(3, 10)]
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1][0] < 120


def test_rows_of_one_id_and_rows_without_one(spark):
    a, b = np.zeros(16), np.zeros(16)
    a[0] = b[1] = 1.0
    near = a.copy()
    near[2] = 0.05
    rows = [(1, a.tolist(), 1), (1, b.tolist(), 1), (2, near.tolist(), 1)]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    # A null id counts as a partner, and names no component.
    rows = [(None, a.tolist(), 1), (5, near.tolist(), 1), (4, a.tolist(), 1), (None, b.tolist(), 1), (None, [0.0] * 16, 1)]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, 4, False), (5, 2, 4, False), (4, 2, 4, True), (None, 0, None, True), (None, 0, None, True)], key=str)


def test_equals_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 24))
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(base)]
    for i in range(40, 160):
        x = base[i % 40] / np.linalg.norm(base[i % 40])
        side = rng.standard_normal(24)
        side -= (side @ x) * x
        # Well above or well below the threshold, so that the last digits do not decide.
        c = rng.choice((0.97, 0.99, 0.995))
        rows.append((i, (c * x + np.sqrt(1 - c * c) * side / np.linalg.norm(side)).tolist(), (i % 40) % 3 if i % 7 else None))
    rows += [(200, None, 1), (201, [0.0] * 24, 1), (202, [float("nan")] * 24, 1), (203, base[0].tolist(), 0), (204, [1.0], 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(E.OP9_SQL)
    columns = ("vec_id", "n_links", "component_id", "kept")
    want = sorted(tuple(dict(zip([c[0] for c in found.description], r, strict=True))[c] for c in columns) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in E.op9_embedding_dedup(spark, str(tmp_path)).collect()) == want and sum(r[1] > 0 for r in want) > 50
