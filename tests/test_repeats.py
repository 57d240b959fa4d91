"""Batches that run again, files that cannot be read, numbers out of range, references anywhere in a text."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import dedup, checks, extraction, layout, retrieval, scoring
from paperloom.operators.store import Store
from paperloom.plans import ingestion
from paperloom.sources import files as sources

from tests import stand_ins

BODIES = {"a.txt": "INVOICE\nVendor Name: ACME\nTotal Amount: 99999999999999999999999999\n* bolts | 100.00\n", "b.txt": "Payslip\nGross Pay: 5\n", "c.txt": "Hi all\n", "d.txt": "Ho all\n"}


@pytest.fixture
def scanned(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in BODIES.items():
        (tmp_path / "in" / name).write_text(body)
    (tmp_path / "in" / "f.jpg").write_bytes(b"\xff\xd8\xff\xe0 not for us")
    return sources.scan(spark, str(tmp_path / "in"))


def state(store):
    return sorted((r["document_id"], r["seq"], r["file_hash_sha256"]) for r in store.current().collect()), sorted((r["document_id"], r["action"]) for r in store.read("audit_log").collect())


def test_a_batch_twice_is_a_batch_once(spark, tmp_path, scanned, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    outcome = {r["original_filename"]: r["outcome"] for r in ingestion.process(scanned, store, 1, stand_ins.providers()).collect()}
    assert outcome["f.jpg"] == "unreadable" and outcome["c.txt"] == outcome["d.txt"] == "auto_accepted" and "rejected" not in outcome.values()
    once = state(store)
    assert len(once[0]) == len(once[1]) == 4
    ingestion.process(scanned, store, 1, stand_ins.providers()).collect()
    assert state(store) == once
    # A try that fails between its two writes, then one that does not.
    other, append = Store(spark, str(tmp_path / "other")), Store.append

    def fails(self, table, *rest):
        if table == "documents":
            raise OSError("lost")
        append(self, table, *rest)

    monkeypatch.setattr(Store, "append", fails)
    with pytest.raises(OSError, match="lost"):
        ingestion.process(scanned, other, 1, stand_ins.providers())
    monkeypatch.setattr(Store, "append", append)
    ingestion.process(scanned, other, 1, stand_ins.providers()).collect()
    assert state(other) == once
    # Another run that counts from 1 again finds the stored documents and overwrites none.
    again = Store(spark, store.root, run="later")
    assert {r["outcome"] for r in ingestion.process(scanned, again, 1, stand_ins.providers()).collect()} == {"duplicate", "unreadable"} and state(store) == once


def test_events_of_a_batch_do_not_replace_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    event = spark.createDataFrame([("d", "viewed", "Ann", "2024-01-01", "", 1)], "document_id string, action string, actor string, timestamp string, detail string, seq long")
    store.record(event, 7)
    store.correct(spark.createDataFrame([("d", "invoice", "total", "4", "5", "Ann", "2024-01-02", "", 3)], "document_id string, doc_type string, field_name string, original_value string, corrected_value string, corrected_by string, corrected_at string, ocr_context_snippet string, seq long"), 7)
    store.record(event, 7)
    assert sorted(r["action"] for r in store.read("audit_log").collect()) == ["field_corrected", "viewed"]


def test_numbers_out_of_range(spark):
    fields = spark.createDataFrame([("d", "total_amount", "9" * 26), ("e", "total_amount", "5"), ("p", "gross_pay", "1" * 30), ("p", "net_pay", "4")], "document_id string, name string, value string")
    cells = spark.createDataFrame([(d, 0, "line_items", i, "amount", v) for d in "de" for i, v in enumerate(("5", "8" * 27))], "document_id string, table_idx int, table_name string, row_index int, col_name string, value string")
    got = {r["document_id"]: (r["passed"], r["detail"]) for r in checks.line_items_check(fields.filter("name = 'total_amount'"), cells).collect()}
    assert got == {"d": (True, "skipped"), "e": (True, "ok")}
    assert checks.deductions_check(fields.filter("document_id = 'p'"), cells.filter("false")).first()["detail"] == "skipped"


def test_references_anywhere_in_an_answer(spark):
    docs = spark.createDataFrame([("abcd1234-5678", 1), ("x7", 2), ("zzzzzzzz9", 3), ("", 4), ("äö", 5)], "document_id string, seq long")
    texts = ["see report_abcd1234.", "x7", "(äö)x7 and zzzzzzzz", "nothing", "", None]
    answers = spark.createDataFrame(list(enumerate(texts)), "answer_id int, raw string")
    got = {r["answer_id"]: r["referenced_documents"] for r in retrieval.references(answers, docs).collect()}
    want = {i: [d for d, s in sorted(((r["document_id"], r["seq"]) for r in docs.collect()), key=lambda x: -x[1]) if d and t and d[:8] in t] for i, t in enumerate(texts)}
    assert {i: got[i] or [] for i in got} == want and want[2] == ["äö", "zzzzzzzz9", "x7"]


def test_the_later_of_two_keys_wins(spark):
    raw = spark.createDataFrame([(1, '{"fields": {"a": 1, "b": 2, "a": 3}, "tables": [{"rows": [{"x": "1", "x": "2"}]}]}'), (2, '{"fields": {"a": 1'), (3, "{}")], "document_id int, raw string")
    answers = raw.select("document_id", F.lit("other").alias("doc_type"), extraction.parse_answer(F.col("raw")).alias("answer"))
    assert [(r["pos"], r["name"], r["value"]) for r in extraction.fields_of(answers).orderBy("pos").collect()] == [(0, "a", "3"), (1, "b", "2")]
    assert [(r["col_name"], r["value"]) for r in extraction.cells_of(answers).collect()] == [("x", "2")]


def test_documents_without_words_and_tables_without_cells(spark):
    words = spark.createDataFrame([("d", 0.5)], "document_id string, confidence double")
    docs = spark.createDataFrame([("d",), ("e",)], "document_id string")
    assert {r["document_id"]: (r["average_confidence"], r["low_confidence_word_count"]) for r in layout.metrics(words, docs).collect()} == {"d": (0.5, 1), "e": (0.0, 0)}
    cells = spark.createDataFrame([("d", 0, 0.25)], "document_id string, table_idx int, confidence double")
    tables = spark.createDataFrame([("d", 0), ("d", 1)], "document_id string, table_idx int")
    assert {r["table_idx"]: r["table_confidence"] for r in scoring.score_tables(cells, tables).collect()} == {0: 0.25, 1: 0.0}


def test_no_id_begins_within_another(spark):
    """ids of digits that begin with the middle, or like the beginning, of one that stands in the answer."""
    docs = spark.createDataFrame([("954446921d7cda37", 1), ("921d7cdaad8f27c0", 2), ("95444692ffffffff", 3), ("1d7cda37", 4)], "document_id string, seq long")
    texts = ["See 954446921d7cda37 for this.", "See 95444692 for this.", "See 954446921d7cda37 and 921d7cda.", "x954446921d7cda37", None]
    answers = spark.createDataFrame(list(enumerate(texts)), "answer_id int, raw string")
    got = {r["answer_id"]: r["referenced_documents"] for r in retrieval.references(answers, docs.filter("seq < 4")).collect()}
    assert got == {0: ["954446921d7cda37"], 1: ["95444692ffffffff", "954446921d7cda37"], 2: ["921d7cdaad8f27c0", "954446921d7cda37"], 3: ["954446921d7cda37"], 4: []}
    # An id that stands there as a whole counts, wherever it stands.
    assert retrieval.references(answers.filter("answer_id = 0"), docs).first()["referenced_documents"] == ["1d7cda37", "954446921d7cda37"]


def test_keys_of_hashes_are_not_broadcast(spark, tmp_path):
    """a hash has 56 keys, and Spark's guess of their size does not count them."""
    hashes = spark.range(300).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("h"))
    hashes.write.parquet(str(tmp_path / "hashes"))
    held = spark.read.parquet(str(tmp_path / "hashes"))
    pairs = dedup.near_pairs(held, held)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert pairs.filter("h = r and distance = 0").count() == 300
