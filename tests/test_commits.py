"""Commits of several tables, versions apart from order, snapshots, and a picture's whole way to its flags."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import checks
from paperloom.operators.store import Store
from paperloom.plans import ingestion
from paperloom.sources import files as sources
from tests import stand_ins

RESULT = ingestion.RESULT
DOCUMENT = "document_id string, file_hash_sha256 string, perceptual_hash string, upload_timestamp string, full_result_json string, doc_type string, seq long"
CORRECTION = "document_id string, doc_type string, field_name string, original_value string, corrected_value string, corrected_by string, corrected_at string, ocr_context_snippet string, seq long"


def documents(spark, *rows):
    return spark.createDataFrame([(i, h, "p", "2024-01-01", j, "invoice", seq) for i, h, j, seq in rows], DOCUMENT)


def correction(spark, value="7", seq=1, document="d"):
    return spark.createDataFrame([(document, "invoice", "total", "5", value, None, "2024-01-02", "", seq)], CORRECTION)


HELD = '{"document_id":"d","extracted_fields":[{"name":"total","value":"5","confidence":{"combined_score":0.2,"bucket":"red"}}],"overall_status":"needs_review"}'


def value(store):
    return store.result("d", RESULT).first()["result"]["extracted_fields"][0]["value"]


def test_a_correction_with_a_small_number_is_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("documents", documents(spark, ("c", "h0", "{}", 400), ("d", "h1", HELD, 500), ("e", "h2", "{}", 600)), 1)
    store.apply_corrections(RESULT, correction(spark), 2)
    assert value(store) == "7" and [r["seq"] for r in store.current().orderBy("seq").collect()] == [400, 500, 600]
    store.apply_corrections(RESULT, correction(spark, "8", 2), 3)
    assert value(store) == "8" and store.result("d", RESULT).first()["result"]["overall_status"] == "auto_accepted"
    # The first batch of corrections again changes nothing: it keeps its version.
    store.apply_corrections(RESULT, correction(spark), 2)
    assert value(store) == "8" and store.read("corrections").count() == 2
    told = store.corrections_of("d").collect()
    assert [(r["corrected_value"], r["corrected_by"]) for r in told] == [("7", "Reviewer"), ("8", "Reviewer")]


@pytest.mark.parametrize("after", [0, 1, 2, 3])
def test_all_tables_of_a_batch_or_none(spark, tmp_path, monkeypatch, after):
    store = Store(spark, str(tmp_path))
    store.append("documents", documents(spark, ("d", "h1", HELD, 500)), 1)
    seen = lambda: (value(store), store.read("corrections").count(), store.read("audit_log").count())
    append, done = Store.append, []

    def fails(self, table, *rest):
        if len(done) == after:
            raise OSError("lost")
        append(self, table, *rest)
        done.append(table)

    monkeypatch.setattr(Store, "append", fails)
    if after == 3:
        monkeypatch.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.apply_corrections(RESULT, correction(spark), 2)
    monkeypatch.undo()
    assert len(done) == after and seen() == ("5", 0, 0)
    store.apply_corrections(RESULT, correction(spark), 2)
    assert seen() == ("7", 1, 1)


def test_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("documents", documents(spark, *[(f"d{i}", f"h{i}", f'{{"doc_type": "{i}"}}', i) for i in range(40)]), 1)
    store.append("documents", documents(spark, ("d3", "new", None, 3)), 2)
    rows = lambda **k: sorted(map(tuple, store.current(**k).select("document_id", "file_hash_sha256", "full_result_json", "seq").collect()))
    before = rows()
    store.compact(buckets=8)
    assert rows() == before and len(before) == 40
    store.append("documents", documents(spark, ("d4", "newer", '{"doc_type": "x"}', 4), ("d99", "h99", "{}", 99)), 3)
    # An old batch again is no newer than what came after it.
    store.append("documents", documents(spark, *[(f"d{i}", f"h{i}", f'{{"doc_type": "{i}"}}', i) for i in range(40)]), 1)
    after = {r[0]: r for r in rows()}
    assert len(after) == 41 and after["d3"][1] == "new" and after["d3"][2] == '{"doc_type": "3"}' and after["d4"][1:] == ("newer", '{"doc_type": "x"}', 4)
    plain = Store(spark, store.root)
    plain._snapshot = lambda: None
    assert rows() == sorted(map(tuple, plain.current().select("document_id", "file_hash_sha256", "full_result_json", "seq").collect()))
    assert [r[0] for r in rows(without_batch=3)] == sorted(r[0] for r in before) and rows(without_batch=1) == [("d3", "new", None, 3), ("d4", "newer", '{"doc_type": "x"}', 4), ("d99", "h99", "{}", 99)]
    store.compact(buckets=4)
    assert {r[0]: r for r in rows()} == after
    assert [r["seq"] for r in store.processed("doc_type string").collect()] == sorted((r[3] for r in after.values()), reverse=True)
    # One document is looked up in one bucket, and in no folder of a batch.
    one = store.current(document_id="d4")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 1 and "/documents/run=" not in plan
    assert [r["file_hash_sha256"] for r in one.collect()] == ["newer"] and store.current(document_id="none").isEmpty()


def test_checks_take_three_exchanges(spark):
    fields = spark.createDataFrame([(i, n, "5") for i in range(50) for n in ("total_amount", "invoice_date", "due_date")], "document_id long, name string, value string")
    cells = spark.createDataFrame([(i, 0, "line_items", 1, "amount", "4") for i in range(50)], "document_id long, table_idx int, table_name string, row_index int, col_name string, value string")
    kinds = spark.createDataFrame([(i, "invoice") for i in range(50)], "document_id long, doc_type string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        found = checks.cross_checks(kinds, fields, cells)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.filter("document_id = 7").orderBy("check_name").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange ") <= 3, plan
    assert [(r["check_name"], r["detail"]) for r in rows] == [("invoice_date_vs_due_date_chronology", "skipped"), ("line_items_sum_vs_total", "ok")]
    bad = checks.cross_checks(kinds, fields.withColumn("value", F.when(F.col("name") == "total_amount", "9").otherwise("2024-01-01")), cells).filter("document_id = 7 and not passed").first()
    assert bad["discrepancy"] == "items add up to 4.00, total_amount is 9.00: 5.00 apart" and bad["fields_compared"] == ["line_items.amount", "total_amount"]


LINES = ("Invoice paper", "Vendor Name: ACME", "Total Amount: 55.00", "all goods were sent on time", "and paid within the month", "thanks for your order")


def scan():
    """A PNG with a bar for every word of LINES, the amount's much bolder, and a patch of coloured noise; and its words."""
    image, words = np.full((200, 420, 3), 255, np.uint8), []
    for i, line in enumerate(LINES):
        x = 10
        for text in line.split():
            box = {"page": 1, "word_idx": len(words), "text": text, "confidence": 90.0, "x": x, "y": 10 + 22 * i, "width": 8 * len(text), "height": 14, "block_num": 0, "par_num": 0, "line_num": i}
            thick = 12 if text == "55.00" else 2
            image[box["y"] + 1 : box["y"] + 1 + thick, x : x + box["width"]] = 0
            words.append(box)
            x += box["width"] + 10
    image[150:190, 200:400] = np.random.default_rng(1).integers(0, 2, (40, 200, 3)) * 255
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    raw = b"".join(b"\x00" + row.tobytes() for row in image)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 420, 200, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""), words


class ScanWords:
    def words(self, kind, content):
        return scan()[1]


def test_flags_of_a_picture(spark, tmp_path):
    from pyspark import cloudpickle

    import tests.test_commits as here

    cloudpickle.register_pickle_by_value(here)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(scan()[0])
    store = Store(spark, str(tmp_path / "store"))
    told = ingestion.process(sources.scan(spark, str(tmp_path / "in")), store, 1, ingestion.Providers(here.ScanWords(), stand_ins.LabelModel())).collect()
    assert [r["original_filename"] for r in told] == ["a.png"] and told[0]["outcome"] == "needs_review"
    flags = {(f["flag_type"], f["affected_field"]): f for f in store.processed(RESULT).first()["r"]["tamper_flags"]}
    assert flags["font_inconsistency", "total_amount"]["evidence"] == "heavier" and ("recompression_artifact", None) in flags
