"""Stages of the pipeline on tables with repeated ids."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, "xx", "s", 1) for i, t in rows], SCHEMA)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in out.collect())


def test_exact_stage_drops_rows_not_ids(spark):
    rows = [(5, "a"), (5, "b"), (9, "A"), (7, "c"), (7, "c"), (7, "C"), (8, "d"), (8, "d"), (None, "b"), (None, "b")]
    assert kept(spark, corpus_pipeline.exact, rows) == [(-1, "b"), (-1, "b"), (5, "b"), (7, "C"), (8, "d"), (9, "A")]


def test_near_stage_drops_rows_not_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, near_a, b = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words))
    assert kept(spark, corpus_pipeline.near, [(9, a), (9, b), (5, near_a)]) == [(5, near_a), (9, b)]
