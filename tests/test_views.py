"""Pictures that are shown, records that are handed out, and counts of a stream."""

import json

import numpy as np
from pyspark.sql import functions as F

from paperloom.functions.text import label
from paperloom.operators import display
from paperloom.operators.store import Store
from paperloom.plans import exports
from paperloom.streaming import ingest

PAGES = "document_id string, page int, height int, width int, channels int, pixels binary"


def test_overlays_and_crops(spark):
    page = np.arange(30 * 40 * 3, dtype=np.uint32).astype(np.uint8).reshape(30, 40, 3)
    pages = spark.createDataFrame([("d", 1, *page.shape, page.tobytes()), ("d", 2, *page.shape, page.tobytes())], PAGES)
    words = spark.createDataFrame([("d", 1, 0, 5, 5, 10, 8, 0.9), ("d", 1, 1, 20, 5, 10, 8, 0.1)], "document_id string, page int, word_idx int, x int, y int, width int, height int, confidence double")
    shown = display.overlays(pages, words).collect()
    image = np.frombuffer(bytes(shown[0]["pixels"]), np.uint8).reshape(30, 40, 3)
    assert len(shown) == 1 and tuple(image[5, 5]) == (0, 160, 0) and tuple(image[5, 20]) == (220, 0, 0) and (image[20:] == page[20:]).all()
    fields = spark.createDataFrame([("d", "a", 1, 15, 12, 5, 4), ("d", "b", 2, 0, 0, 3, 3), ("d", "off", 1, 99, 0, 3, 3), ("d", "none", None, 1, 1, 3, 3)], "document_id string, name string, page int, x int, y int, width int, height int")
    got = {r["name"]: (r["page"], np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(r["height"], r["width"], 3)) for r in display.crops(pages, fields).collect()}
    assert set(got) == {"a", "b"} and got["b"][0] == 2 and (got["a"][1] == page[2:26, 5:30]).all() and (got["b"][1] == page[:13, :13]).all()


def test_whole_records_as_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [("d", "h", "p", "t", '{"document_id":"d","doc_type":"invoice","original_filename":"a.b.pdf","is_confidential":true}', "invoice", 1), ("e", "i", "p", "t", '{"document_id":"e"}', None, 2), ("f", "j", "p", "t", None, None, 3)]
    store.append("documents", spark.createDataFrame(rows, "document_id string, file_hash_sha256 string, perceptual_hash string, upload_timestamp string, full_result_json string, doc_type string, seq long"), 1)
    exports.export_records(store, str(tmp_path / "all"))
    got = {r["document_id"]: r for r in spark.read.json(str(tmp_path / "all")).collect()}
    assert {i: r["file_name"] for i, r in got.items()} == {"d": "a.b_extracted_record.json", "e": "e_extracted_record.json"}
    held = json.loads(got["d"]["record"])
    assert held["doc_type"] == "invoice" and held["is_confidential"] is True and held["extracted_fields"] is None and "\n" in got["d"]["record"]
    exports.export_records(store, str(tmp_path / "one"), spark.createDataFrame([("e",)], "document_id string"))
    assert [r["document_id"] for r in spark.read.json(str(tmp_path / "one")).collect()] == ["e"]


def test_counts_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "viewed"), ("2024-01-01 12:00:00", "viewed"), ("2024-01-02 01:00:00", "corrected"), ("2024-01-05 00:00:00", "viewed")]
    frame = spark.createDataFrame(rows, "timestamp string, action string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    counted = ingest.event_counts(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    counted.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start().awaitTermination()
    assert {(r["d"], r["action"]): r["n"] for r in spark.sql("select date(window.start) as d, action, n from counted").selectExpr("cast(d as string) d", "action", "n").collect()} == {("2024-01-01", "viewed"): 2, ("2024-01-02", "corrected"): 1, ("2024-01-05", "viewed"): 1}


def test_labels_are_title_case(spark):
    names = ["vendor_name", "address2line", "o'neil_iD", "", "ÉCOLE_été", "__x"]
    got = [r["l"] for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i").select(label(F.col("n")).alias("l")).collect()]
    assert got == [n.replace("_", " ").title() for n in names]
