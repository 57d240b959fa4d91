"""Golden cases of the scalar expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.functions import scores, text, values


def evaluate(spark, rows, expression, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    out = spark.createDataFrame(rows, schema).withColumn("out_", expression(*[F.col(c) for c in names]))
    return [r["out_"] for r in out.collect()]


def check(spark, cases, expression, schema):
    got = evaluate(spark, [c[:-1] for c in cases], expression, schema)
    assert list(zip([c[:-1] for c in cases], got)) == [(c[:-1], c[-1]) for c in cases]


def test_combine(spark):
    cases = [(0.9, 0.8, True, (0.88, "green")), (0.9, None, True, (0.9333, "green")), (0.75, 0.625, True, (0.75, "green")), (1.0, 1.0, False, (0.5, "amber")), (0.0, 1.0, True, (0.6, "amber")),
             (0.0, 0.5, True, (0.4, "amber")), (0.1, 0.4, True, (0.4, "amber")), (0.6, None, False, (0.4, "amber")), (0.5, None, False, (0.3333, "red")), (0.0, None, True, (0.3333, "red"))]
    got = evaluate(spark, [c[:3] for c in cases], scores.combine, "ocr double, llm double, rule boolean")
    assert [(g["combined_score"], g["bucket"]) for g in got] == [c[3] for c in cases]
    assert got[1]["llm_confidence"] is None and got[0]["ocr_confidence"] == 0.9


def test_amounts(spark):
    check(spark, [("$1,234.50", 1234.5), ("1.234,56", 1.23456), ("(500)", 500.0), ("Rs. 500", 0.5), ("INR 1,200", 1200.0), ("1,234.50-", None), ("12-34", None), ("-42", -42.0), ("abc", None), ("1.2.3", None), (None, None), ("", None)], values.parse_amount, "v string")


def test_dates(spark):
    d = dt.date
    check(spark, [("2024-1-5", d(2024, 1, 5)), ("05/06/2024", d(2024, 6, 5)), ("06/25/2024", d(2024, 6, 25)), ("31/02/2024", None), ("5 JAN 2024", d(2024, 1, 5)), ("Jan 5, 2024", d(2024, 1, 5)), ("January  5 2024", d(2024, 1, 5)),
                  ("Sept 5 2024", None), ("15.01.2024", None), ("2024.01.15", d(2024, 1, 15)), ("2024115", d(2024, 11, 5)), ("1/2/24", None), ("2024-01-05T10:00:00", None), (None, None), ("  2024-01-05\n", d(2024, 1, 5))], values.parse_date, "v string")


def test_rules(spark):
    cases = [(v, "amount", True) for v in ("$1,234.50", "USD 99", "nan", "1_000", "1.234,56", "-5", "1e5")] + [(v, "amount", False) for v in ("Rs. 500", "(500)", "1d", "1.0f", "")]
    cases += [(v, "date", True) for v in ("15.01.2024", "1/2/24", "99/99/2024", "5 Jan 2024")] + [(v, "date", False) for v in ("January 2024", "2024-01-05T10:00:00")]
    cases += [("A", "id_number", False), ("--", "id_number", False), ("A1", "id_number", True), ("X", "name", False), ("Jo", "name", True), ("12", "name", False), ("x" * 101, "name", False), (" None ", "text", False), ("x", "text", True), ("x", "colour", True), (None, "text", False)]
    check(spark, cases, values.rule_passed, "v string, t string")


def test_masks(spark):
    check(spark, [("1234 5678-9012", "id_number", "XXXX-XXXX-9012"), ("A1", "id_number", "XXXX-XXXX-A1"), ("John Doe", "name", "J*** D***"), ("Prince", "name", "P******"), ("Al B", "name", "A*** B***"), ("any", "date", "XX/XX/XXXX"),
                  ("USD 5,000", "amount", "USD **,***.**"), ("$5,000", "amount", "$**,***.**"), ("5000", "amount", "**,***.**"), ("abcd", "text", "****"), ("hello", "text", "h***o"), (None, "text", ""), ("None", "name", "None")], text.mask_value, "v string, t string")


def test_types_and_labels(spark):
    cases = [("payment_date", "x", "date"), ("issuer_name", "x", "date"), ("tax_id", "x", "amount"), ("employee_id", "x", "name"), ("customer_id", "x", "name"), ("width", "x", "id_number"), ("protein", "x", "id_number"), ("memo", "$1,200.50", "amount"), ("memo", "2024/1/5", "date"), ("memo", "hello", "text")]
    check(spark, cases, text.infer_type, "n string, v string")
    check(spark, [("Invoice.", "invoice"), ("**payslip**", "payslip"), ("bank statement", "other")], text.doc_type_label, "v string")
    check(spark, [("invoice", "total_amount", "1", "amount"), ("other", "total_amount", "1", "amount"), ("id_proof", "address", "1", "text"), ("nonsense", "iban", "x", "text")], text.expected_type, "t string, n string, v string")


def test_snippets_and_normal_forms(spark):
    check(spark, [("x" * 80, "x" * 80), ("x" * 81, "x" * 77 + "..."), ("a\nb ", "a b"), (None, "")], text.snippet, "v string")
    check(spark, [("É-n_1!", "én_1"), ("--", "")], text.normalised, "v string")


def test_cells_ratings_status(spark):
    check(spark, [(None, "x", 0.86), (0.95, "x", 0.965), (None, "", 0.5), (0.2, None, 0.14)], scores.cell_score, "o double, v string")
    check(spark, [("0.5", 0.5), ("7", 1.0), ("-1", 0.0), ("high", None), (None, None), ("NaN", 1.0)], scores.clamp_rating, "v string")
    check(spark, [("rejected_too_degraded", True, True, True, "rejected"), ("ok", False, False, False, "auto_accepted"), ("ok", None, None, None, "auto_accepted"), ("ok", True, None, None, "needs_review"), ("ok", None, None, True, "needs_review")], scores.overall_status, "q string, r boolean, f boolean, h boolean")


def test_metadata_times(spark):
    t = dt.datetime
    check(spark, [("D:20240105101112+05'30'", t(2024, 1, 5, 10, 11, 12)), ("20240105", t(2024, 1, 5)), ("D:20241399", None), ("x", None), (None, None)], lambda v: values.pdf_date(v).cast("timestamp_ntz"), "v string")
    check(spark, [("2024:01:05 10:11:12", t(2024, 1, 5, 10, 11, 12)), ("2024-01-05", None)], lambda v: values.exif_date(v).cast("timestamp_ntz"), "v string")


def test_crop(spark):
    cases = [(5, 5, 10, 10, (0, 0, 25, 25)), (95, 95, 10, 10, (85, 85, 100, 100)), (100, 5, 10, 10, None), (5, 5, 0, 10, None), (-50, 5, 10, 10, None)]
    got = evaluate(spark, [c[:4] for c in cases], lambda x, y, w, h: scores.crop(x, y, w, h, F.lit(100), F.lit(100)), "x int, y int, w int, h int")
    assert [tuple(g) if g else None for g in got] == [c[4] for c in cases]


@pytest.mark.parametrize("n,expected", [(0, (False, "none")), (1, (False, "none")), (2, (True, "low")), (3, (True, "high"))])
def test_sensitivity(spark, n, expected):
    got = evaluate(spark, [("invoice", n), ("payslip", n)], scores.sensitivity, "t string, n int")
    assert tuple(got[0]) == expected and tuple(got[1]) == (True, "high")
