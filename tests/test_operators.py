"""Operators against plain Python on small tables, and whole runs over files."""

import difflib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import checks, dedup, extraction, grounding, layout, pixels, quality, retrieval, review, scoring
from paperloom.operators.store import Store, fold_versions
from paperloom.sources import files as sources
from paperloom.sources import providers

from tests import stand_ins

WORDS = "document_id string, page int, word_idx int, text string, confidence double, x int, y int, width int, height int, block_num int, par_num int, line_num int"


def words(spark, rows):
    return spark.createDataFrame(rows, WORDS)


def test_lines_without_keys_go_by_height(spark):
    w = words(spark, [("d", 1, 0, "world", 0.9, 60, 31, 40, 10, None, None, None), ("d", 1, 1, "hello", 0.7, 10, 30, 40, 12, None, None, None), ("d", 1, 2, "next", 0.5, 10, 50, 30, 10, None, None, None), ("d", 1, 3, " ", 0.9, 0, 0, 1, 1, None, None, None), ("d", 1, 4, "x", -0.01, 0, 0, 1, 1, None, None, None)])
    lines = layout.words_to_lines(layout.without_noise(w)).orderBy("line_idx").collect()
    assert [(r["text"], r["confidence"], r["x"], r["y"], r["width"], r["height"]) for r in lines] == [("hello world", 0.8, 10, 30, 90, 12), ("next", 0.5, 10, 50, 30, 10)]


def test_grounding_tiers(spark):
    w = words(spark, [("d", 1, i, t, 0.9, x, y, 30, 10, 0, 0, line) for i, (t, x, y, line) in enumerate([("Total:", 0, 10, 0), ("150.00", 40, 10, 0), ("--", 80, 12, 0), ("vendor", 0, 40, 1), ("Acme", 40, 40, 1), ("C0rp", 80, 40, 1)])])
    lines = layout.words_to_lines(w)
    values = spark.createDataFrame([("d", "total", "150.00"), ("d", "vendor", "vendor acme corp"), ("d", "none", "null"), ("d", "far", "zzzzzz"), ("d", "dots", "...")], "document_id string, name string, value string")
    got = {r["name"]: r for r in grounding.ground(values, lines, w).collect()}
    assert set(got) == {"total", "vendor"}
    # A word of punctuation near the line counts in the box.
    assert (got["total"]["method"], got["total"]["raw_text"], got["total"]["x"], got["total"]["width"]) == ("line", "150.00 --", 40, 70)
    assert got["vendor"]["method"] == "similar" and got["vendor"]["score"] == pytest.approx(difflib.SequenceMatcher(None, "vendor acme corp", "vendor acme c0rp").ratio())


@pytest.mark.parametrize("a,b,ratio", [("acme corp", "acme c0rp", 0.8889), ("tide", "diet", 0.25), ("diet", "tide", 0.5), ("invoice 001", "invoice no 001", 0.88)])
def test_similarity(spark, a, b, ratio):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(grounding.similarity("a", "b").alias("r")).first()
    assert round(row["r"], 4) == ratio


def test_similar_lines_lose_nothing_to_their_bounds(spark):
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcde .1") for _ in range(n))
    lines = [text(rnd.randint(1, 30)) for _ in range(60)]
    mixed = lambda t: "".join(c if rnd.random() > 0.15 else rnd.choice("xyz") for c in t)
    values = [mixed(rnd.choice(lines)) + "q" for _ in range(40)]
    ln = spark.createDataFrame([("d", 1, i, t, 0, 0, 1, 1) for i, t in enumerate(lines)], "document_id string, page int, line_idx int, text string, x int, y int, width int, height int")
    vs = spark.createDataFrame([("d", f"v{i}", t) for i, t in enumerate(values)], "document_id string, name string, value string")
    ratio = lambda v, t: difflib.SequenceMatcher(None, v.strip().lower(), t.lower()).ratio()
    want = {(f"v{i}", k) for i, v in enumerate(values) for k, t in enumerate(lines) if ratio(v, t) >= 0.75}
    left = {(r["name"], r["line_idx"]) for r in grounding.similar_candidates(vs, ln).collect()}
    assert want <= left and len(want) > 10 and len(left) < 40 * 60 / 5
    got = {r["name"]: r["score"] for r in grounding.by_similarity(vs, ln).collect()}
    assert got == pytest.approx({n: max(ratio(values[int(n[1:])], lines[k]) for m, k in want if m == n) for n, _ in want})


def test_line_item_cases(spark):
    fields = spark.createDataFrame([("ok", "total_amount", "151.00"), ("bad", "total_amount", "151.01"), ("none", "vendor_name", "x"), ("unread", "total_amount", "1")], "document_id string, name string, value string")
    cells = spark.createDataFrame([(d, 0, "line_items", i, "amount", v) for d in ("ok", "bad") for i, v in enumerate(("100.00", "49.99", "0.01"))] + [("unread", 0, "line_items", 1, "amount", "n/a"), ("ok", 1, "line_items", 1, "amount", "7")], "document_id string, table_idx int, table_name string, row_index int, col_name string, value string")
    got = {r["document_id"]: (r["passed"], r["detail"]) for r in checks.line_items_check(fields, cells).collect()}
    assert got == {"ok": (True, "ok"), "bad": (False, "sum differs from total"), "none": (True, "skipped"), "unread": (True, "skipped")}


def test_deduction_cases(spark):
    pay = lambda d, *more: [(d, "gross_pay", "1000"), (d, "net_pay", "900"), *[(d, *m) for m in more]]
    fields = spark.createDataFrame(pay("table") + pay("stated", ("total_deductions", "100")) + pay("unread", ("total_deductions", "100")) + [("part", "gross_pay", "1")], "document_id string, name string, value string")
    cells = spark.createDataFrame([("table", 0, "Deductions", 1, "amount", "60"), ("table", 0, "Deductions", 2, "deduction_amount", "40"), ("unread", 0, "deductions", 1, "amount", "?")], "document_id string, table_idx int, table_name string, row_index int, col_name string, value string")
    got = {r["document_id"]: r["passed"] for r in checks.deductions_check(fields, cells).collect()}
    assert got == {"table": True, "stated": True, "unread": False, "part": True}


def test_metadata_gaps(spark):
    base = "2024-01-01 00:00:00"
    rows = [(1, 1.0), (2, 1.5), (3, 14.0), (4, 14.1), (5, -0.5), (6, 0.0)]
    meta = spark.createDataFrame([(i, d) for i, d in rows], "document_id int, days double").select("document_id", F.lit(base).cast("timestamp").alias("created"), (F.lit(base).cast("timestamp") + F.make_dt_interval(secs=F.round(F.col("days") * 86400).cast("decimal(18,6)"))).alias("modified"), F.when(F.col("document_id") == 6, "Paint.NET").alias("software"))
    got = {r["document_id"]: (r["severity"], r["evidence"]) for r in checks.metadata_flags(meta).collect()}
    assert {i: s for i, (s, _) in got.items()} == {2: "medium", 3: "medium", 4: "high", 5: "high", 6: "high"} and got[6][1].endswith("paint")


def test_near_hashes_equal_brute_force(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(60)]
    more = [b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 8))) for b in base]
    frame = lambda xs: spark.createDataFrame([(f"{x:016x}",) for x in xs], "h string")
    got = {(r["h"], r["r"], r["distance"]) for r in dedup.near_pairs(frame(base), frame(more)).collect()}
    assert got == {(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a in base for b in more if (a ^ b).bit_count() <= 5}


def test_duplicates_and_order(spark):
    docs = lambda rows: spark.createDataFrame(rows, "document_id string, file_hash string, perceptual_hash string, seq long")
    stored = docs([("s1", "a", "0000000000000000", 1), ("s2", "b", "ffffffffffffffff", 2), ("s3", "c", "fffffffffffffffe", 3)])
    new = docs([("n1", "a", "ffffffffffffffff", 4), ("n2", "x", "ffffffffffffffff", 5), ("n3", "y", "000000000000003f", 6), ("n4", "z", "000000000000001f", 7), ("n5", "w", "not hex", 8), ("s2", "b", None, 9)])
    got = {r["document_id"]: (r["matched_document_id"], r["match_type"], r["distance"]) for r in dedup.find_duplicates(new, stored).collect()}
    assert got == {"n1": ("s1", "exact_hash", None), "n2": ("s2", "perceptual_hash_similarity", 0), "n4": ("s1", "perceptual_hash_similarity", 5)}
    # B is near A and dropped; C is near B alone and kept.
    chain = docs([("A", "1", "0000000000000000", 1), ("B", "2", "000000000000001f", 2), ("C", "3", "00000000000003ff", 3), ("D", "3", None, 4)])
    assert {r["document_id"] for r in dedup.accepted_in_order(chain).collect()} == {"A", "C"}


def test_order_of_acceptance_equals_a_loop(spark):
    rnd = random.Random(9)
    hashes = [0]
    for _ in range(120):
        hashes.append(rnd.choice(hashes) ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 6))))
    kept = []
    for i, h in enumerate(hashes):
        if all((h ^ hashes[k]).bit_count() > 5 for k in kept):
            kept.append(i)
    frame = spark.createDataFrame([(str(i), str(i), f"{h:016x}", i) for i, h in enumerate(hashes)], "document_id string, file_hash string, perceptual_hash string, seq long")
    assert {int(r["document_id"]) for r in dedup.accepted_in_order(frame).collect()} == set(kept)


def test_versions_fold_like_a_dictionary(spark):
    rnd = random.Random(3)
    rows, model = [], {}
    for seq in range(200):
        key, h, j = f"d{rnd.randint(0, 9)}", str(rnd.random()), rnd.choice([None, str(rnd.random())])
        rows.append((key, seq, h, j))
        old = model.get(key)
        model[key] = (old[0] if old else seq, h, j if j is not None else old and old[2])
    got = fold_versions(spark.createDataFrame(rows, "k string, seq long, h string, j string"), "k", ["h"], ["j"])
    assert {r["k"]: (r["seq"], r["h"], r["j"]) for r in got.collect()} == model


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.current().count() == 0 and store.read("audit_log").count() == 0
    doc = lambda j, h, seq: spark.createDataFrame([("d", h, "p", "2024-01-01", j, "invoice" if j else None, seq)], "document_id string, file_hash_sha256 string, perceptual_hash string, upload_timestamp string, full_result_json string, doc_type string, seq long")
    store.append("documents", doc('{"doc_type": "payslip"}', "h1", 1), 1)
    store.append("documents", doc(None, "h2", 2), 2)
    store.append("documents", doc(None, "h2", 2), 2)  # a batch written again replaces itself
    row = store.current().first()
    assert (row["file_hash_sha256"], row["doc_type"], row["seq"], store.read("documents").count()) == ("h2", "invoice", 1, 2)
    assert store.result("d", "doc_type string").first()["result"]["doc_type"] == "payslip" and store.result("x", "doc_type string").isEmpty()
    store.correct(spark.createDataFrame([("d", "invoice", " total ", None, " 5 ", "Ann", "2024-01-02", "", 3)], "document_id string, doc_type string, field_name string, original_value string, corrected_value string, corrected_by string, corrected_at string, ocr_context_snippet string, seq long"), 3)
    assert store.read("corrections").first()["corrected_value"] == "5" and store.read("audit_log").first()["action"] == "field_corrected"
    store.save_json(spark.createDataFrame([("d", "{}", 4), ("ghost", "{}", 5)], "document_id string, full_result_json string, seq long"), 4)
    assert store.current().first()["full_result_json"] == "{}" and store.processed("doc_type string").count() == 1


def test_answers_and_json(spark):
    raw = ['{"fields": {"b": 1, "a": "x", "n": null}, "tables": []}', '```json\n{"fields": "{\\"a\\": \\"y\\"}"}\n```', "Sure: {\"fields\": {\"a\": 1.5}} ok", "nothing", '["a"]', None]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "document_id int, raw string").select("document_id", F.lit("other").alias("doc_type"), extraction.parse_answer(F.col("raw")).alias("answer"))
    rows = extraction.fields_of(frame).orderBy("document_id", "pos").collect()
    assert [(r["document_id"], r["name"], r["value"]) for r in rows] == [(0, "b", "1"), (0, "a", "x"), (1, "a", "y"), (2, "a", "1.5")]
    assert [r["name"] for r in extraction.skipped_fields(frame).collect()] == ["n"]
    answers = spark.createDataFrame([(1, 'See abcdefgh.\nREFERENCED_DOCS: ["q"]'), (2, "I don't have that information"), (3, "abcdefgh12345678 it is")], "answer_id int, raw string")
    docs = spark.createDataFrame([("abcdefgh12345678", 1), ("zzzzzzzz99999999", 2)], "document_id string, seq long")
    got = {r["answer_id"]: (r["answer"], r["referenced_documents"]) for r in retrieval.references(answers, docs).collect()}
    assert got == {1: ("See abcdefgh.", ["q", "abcdefgh12345678"]), 2: ("I don't have that information", []), 3: ("abcdefgh12345678 it is", ["abcdefgh12345678"])}


def test_pins_and_priorities(spark):
    pins = {"admin": "1"}
    assert review.verify_pin(pins, " Admin ", 1) and not review.verify_pin(pins, "admin", None) and not review.verify_pin(pins, None, "1") and not review.verify_pin(pins, "guest", "1")
    f = spark.createDataFrame([("d", 0, "green", 0.9, False), ("d", 1, "red", 0.3, False), ("d", 2, "red", 0.1, True), ("d", 3, "amber", 0.5, False), ("d", 4, "red", 0.2, False)], "document_id string, pos int, bucket string, combined_score double, manually_corrected boolean")
    assert [r["pos"] for r in review.by_priority(f).collect()] == [4, 1, 3, 2, 0]


def test_scores_of_fields(spark):
    f = spark.createDataFrame([("d", "a", "5", "amount", 1, 0, 0, 30, 10), ("d", "b", "x", "amount", None, None, None, None, None)], "document_id string, name string, value string, field_type string, page int, x int, y int, width int, height int")
    w = words(spark, [("d", 1, 0, "5", 0.8, 32, 0, 10, 10, 0, 0, 0), ("d", 1, 1, "6", 0.2, 33, 0, 10, 10, 0, 0, 0), ("d", 2, 2, "7", 0.1, 0, 0, 10, 10, 0, 0, 0)])
    got = {r["name"]: r["confidence"] for r in scoring.score_fields(f, w, spark.createDataFrame([("d", "a", 1.0)], "document_id string, name string, llm_confidence double")).collect()}
    assert (got["a"]["ocr_confidence"], got["a"]["combined_score"], got["b"]["ocr_confidence"], got["b"]["bucket"]) == (0.8, 0.92, 0.0, "red")


def png(image):
    h, w, n = image.shape
    import struct

    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    filtered = b""
    for y in range(h):
        kind = y % 5
        row, up = image[y].ravel().astype(int), image[y - 1].ravel().astype(int) if y else np.zeros(w * n, int)
        left, corner = np.concatenate((np.zeros(n, int), row[:-n])), np.concatenate((np.zeros(n, int), up[:-n]))
        p = left + up - corner
        choices = np.stack((left, up, corner))
        paeth = choices[np.argmin(np.abs(p - choices), axis=0), np.arange(w * n)]
        guess = (0, left, up, (left + up) // 2, paeth)[kind]
        filtered += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(filtered)) + part(b"IEND", b"")


def test_pixels():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 30, 3), dtype=np.uint8)
    assert (providers.decode_png(png(image)) == image).all()
    assert (providers.decode_netpbm(b"P6\n30 40\n255\n" + image.tobytes()) == image).all()
    assert quality.laplacian_variance(np.full((20, 20), 7.0)) == 0.0 < quality.laplacian_variance(image[:, :, 0].astype(float))
    a = quality.perceptual_hash(image[:, :, 0].astype(float))
    assert len(a) == 16 and a == quality.perceptual_hash(image[:, :, 0].astype(float) + 1)
    page = np.full((200, 300), 255.0)
    page[20:180:20, 20:280] = 0
    assert pixels.skew_angle(page) == 0 and pixels.skew_angle(np.full((50, 50), 255.0)) == 0
    turned = pixels.rotated(page[..., None].astype(np.uint8), 5.0)[..., 0].astype(float)
    assert abs(abs(pixels.skew_angle(turned)) - 5) <= 0.5
    bar = np.full((30, 60), 255.0)
    bar[12:18, 5:55] = 0
    assert 3 < pixels.stroke_width(bar) < 6 and pixels.stroke_width(np.full((5, 5), 9.0)) == 0
    assert pixels.bilateral(image).shape == image.shape and (pixels.bilateral(np.full((12, 12, 3), 9, np.uint8)) == 9).all()
    framed = pixels.with_boxes(image, [(5, 5, 10, 10, "red")])
    assert (framed[5, 5] == (220, 0, 0)).all() and (framed[9, 9] == image[9, 9]).all() and pixels.cropped(image, (0, 0, 4, 3)).shape == (3, 4, 3) and pixels.cropped(image, None) is None
    assert pixels.recompression_error(np.full((16, 16, 3), 77, np.uint8))[0] < 1 and pixels.recompression_error(image)[1] > 1.5


def test_pages_roll_up(spark):
    rows = [("d", 1, 150.0, -2.0), ("d", 2, 90.0, 2.0), ("e", 1, 100.0, 1.0)]
    got = {r["document_id"]: (r["status"], r["blur_score"], r["skew_angle_degrees"]) for r in quality.rollup(spark.createDataFrame(rows, "document_id string, page int, blur_score double, skew_angle double")).collect()}
    assert got == {"d": ("rejected_too_degraded", 90.0, -2.0), "e": ("ok", 100.0, 1.0)}


def test_models_fall_back():
    class Fails:
        def complete(self, prompt):
            raise OSError("down")

    class Silent:
        def complete(self, prompt):
            return " "

    class Answers:
        def complete(self, prompt):
            return " yes "

    assert providers.Fallback([Fails(), Silent(), Answers()], pause=0).complete("?") == "yes"
    with pytest.raises(providers.Unavailable):
        providers.Fallback([Fails(), Silent()], pause=0).complete("?")
    with pytest.raises(providers.Unavailable):
        providers.ImagePages().pages("pdf", b"%PDF-1.4")


def test_file_facts(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.4 /Type /Pages /Type /Page /Type/Page /CreationDate (D:20240101000000) /ModDate (D:20240301000000) /Creator (GIMP)")
    (tmp_path / "b.png").write_bytes(b"%PDF in disguise")
    (tmp_path / "c.exe").write_bytes(b"x")
    found = sources.scan(spark, str(tmp_path))
    assert {r["original_filename"]: r["kind"] for r in found.collect()} == {"a.PDF": "pdf", "b.png": "pdf"}
    meta = sources.metadata(found.filter("original_filename = 'a.PDF'"))
    row = meta.first()
    assert (row["page_count"], row["software"], row["created"].month, row["modified"].month) == (2, "GIMP", 1, 3)
    assert {r["severity"] for r in checks.metadata_flags(meta).collect()} == {"high"}


def test_whole_run(spark, tmp_path):
    from paperloom.plans.ingestion import RESULT
    from paperloom.streaming.ingest import start

    (tmp_path / "in").mkdir()
    invoice = "INVOICE\nVendor Name: ACME Corp\nInvoice Number: INV-001\nInvoice Date: 05/06/2024\nDue Date: 01/06/2024\nTotal Amount: 150.00\nNote: none\n* bolts | 100.00\n* nuts | 50.00\n"
    for name, body in (("a", invoice), ("b", "Payslip\nEmployee Name: Jane Doe\nGross Pay: 1,000\nNet Pay: 900\nTotal Deductions: 100\n"), ("c", invoice)):
        (tmp_path / "in" / f"{name}.txt").write_text(body)
    store = Store(spark, str(tmp_path / "store"))
    run = lambda: start(spark, str(tmp_path / "in"), store, str(tmp_path / "checkpoint"), providers=stand_ins.providers()).awaitTermination()
    run()
    got = {r["r"]["doc_type"]: r["r"] for r in store.processed(RESULT).collect()}
    assert set(got) == {"invoice", "payslip"} and store.read("audit_log").count() == 2
    assert got["invoice"]["overall_status"] == "needs_review" and got["payslip"]["overall_status"] == "auto_accepted" and got["payslip"]["is_confidential"]
    assert [f["name"] for f in got["invoice"]["extracted_fields"]] == ["vendor_name", "invoice_number", "invoice_date", "due_date", "total_amount"]
    assert {c["check_name"]: c["passed"] for c in got["invoice"]["cross_checks"]} == {"line_items_sum_vs_total": True, "invoice_date_vs_due_date_chronology": False}
    (tmp_path / "in" / "d.txt").write_text(invoice)
    run()
    assert store.current().count() == 2
    change = spark.createDataFrame([(got["invoice"]["document_id"], "invoice", "due_date", "01/06/2024", "01/07/2024", "Ann", "2024-07-01", "Due Date: 01/06/2024", 5_000_000_000)], "document_id string, doc_type string, field_name string, original_value string, corrected_value string, corrected_by string, corrected_at string, ocr_context_snippet string, seq long")
    store.apply_corrections(RESULT, change, 50)
    fixed = {f["name"]: f for f in store.result(got["invoice"]["document_id"], RESULT).first()["result"]["extracted_fields"]}
    assert fixed["due_date"]["value"] == "01/07/2024" and fixed["due_date"]["confidence"]["combined_score"] == 1.0 and fixed["vendor_name"]["value"] == "ACME Corp"
    from paperloom.plans.questions import answer

    class Says:
        def complete(self, prompt):
            assert "ACME Corp" in prompt and "INV-001" not in prompt
            return f'It is ACME. REFERENCED_DOCS: ["{got["invoice"]["document_id"]}"]'

    told = answer(store, "Who is the vendor?", Says(), [{"role": "user", "content": "hello"}])
    assert told == {"answer": "It is ACME.", "referenced_documents": [got["invoice"]["document_id"]]}
    assert answer(Store(spark, str(tmp_path / "none")), "x", Says())["referenced_documents"] == []
