"""Business checks: sums, net pay, order of dates, fonts.

fields: document_id, name, value. cells: document_id, table_idx, table_name, row_index, col_name, value.
Every check is a record: check_name, the fields compared, what is expected of them, whether it passed, its outcome in a word and, unless
it is ok, the figures or why it was skipped. A check that lacks its inputs passes as skipped. An amount of
more than 22 digits before the point is no amount: such an item does not count, and a check with such a total is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.functions.values import parse_amount, parse_date

SKIPPED = "skipped"
MONEY = "decimal(28,6)"
RECORD = ("check_name", "fields_compared", "expected_relationship", "passed", "detail", "discrepancy")


def money(value: Column) -> Column:
    return value.try_cast(MONEY)


def _two_places(value: Column) -> Column:
    return value.cast("decimal(28,2)").cast("string")


def _record(name: str | Column, compared: list[str], expected: str | Column, known: Column, holds: Column, failure: str, figures: Column) -> Column:
    """A check: skipped where not known, else ok or failed, with figures that say how."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        lit(name).alias("check_name"),
        F.array(*map(F.lit, compared)).alias("fields_compared"),
        lit(expected).alias("expected_relationship"),
        (~known | holds).alias("passed"),
        F.when(~known, SKIPPED).when(holds, "ok").otherwise(failure).alias("detail"),
        F.when(~known, "skipped: fields are missing or cannot be read").when(~holds, figures).alias("discrepancy"),
    )


def sum_record(item_sum: Column, total: Column, tolerance: float = K.SUM_TOLERANCE) -> Column:
    """Items (money) against a declared total."""
    diff = sum_difference(item_sum, total)
    figures = F.concat(F.lit("items add up to "), _two_places(F.round(item_sum, 2)), F.lit(", total_amount is "), _two_places(money(total)), F.lit(": "), _two_places(diff), F.lit(" apart"))
    expected = f"the sum of line_items.amount is total_amount, give or take {tolerance:.2f}"
    return _record("line_items_sum_vs_total", ["line_items.amount", "total_amount"], expected, diff.isNotNull(), diff <= tolerance, "sum differs from total", figures)


def sum_difference(item_sum: Column, total: Column) -> Column:
    return F.round(F.abs(F.round(item_sum, 2) - money(total)), 2)


def expected_net(gross: Column, deductions: Column) -> Column:
    return F.round(money(gross) - F.coalesce(money(deductions), F.lit(0)), 2)


def net_difference(gross: Column, deductions: Column, net: Column) -> Column:
    return F.round(F.abs(expected_net(gross, deductions) - money(net)), 2)


def net_record(gross: Column, deductions: Column, net: Column, tolerance: float = K.SUM_TOLERANCE) -> Column:
    diff = net_difference(gross, deductions, net)
    figures = F.concat(F.lit("gross_pay less deductions is "), _two_places(expected_net(gross, deductions)), F.lit(", net_pay is "), _two_places(money(net)), F.lit(": "), _two_places(diff), F.lit(" apart"))
    expected = f"gross_pay less the sum of deductions is net_pay, give or take {tolerance:.2f}"
    return _record("deductions_vs_net_pay", ["gross_pay", "deductions.amount", "net_pay"], expected, diff.isNotNull(), diff <= tolerance, "gross less deductions differs from net", figures)


def date_record(start_name: str, end_name: str, start: Column, end: Column) -> Column:
    known, late = start.isNotNull() & end.isNotNull(), end >= start
    figures = F.concat(F.lit(f"{end_name} "), end.cast("string"), F.lit(f" is before {start_name} "), start.cast("string"))
    return _record(f"{start_name}_vs_{end_name}_chronology", [start_name, end_name], f"{end_name} is not before {start_name}", known, late, "end is before start", figures)


def sum_check(declared: DataFrame, items: DataFrame, tolerance: float = K.SUM_TOLERANCE) -> DataFrame:
    """declared (document_id, total) against the sum of items (document_id, amount), all rows of declared kept."""
    sums = items.groupBy("document_id").agg(F.try_sum(money(F.col("amount"))).alias("item_sum"))
    out = declared.join(sums, "document_id", "left").withColumn("r", sum_record(F.col("item_sum"), F.col("total"), tolerance))
    difference = sum_difference(F.col("item_sum"), F.col("total")).cast("double")
    return out.select("document_id", "r.check_name", F.round("item_sum", 2).cast("double").alias("item_sum"), difference.alias("difference"), "r.passed", "r.detail")


def net_pay_check(pay: DataFrame, tolerance: float = K.SUM_TOLERANCE) -> DataFrame:
    """pay: document_id, gross, net, deductions (null counts as none)."""
    own = F.col("gross"), F.col("deductions")
    out = pay.withColumn("r", net_record(*own, F.col("net"), tolerance))
    return out.select("document_id", "r.check_name", expected_net(*own).cast("double").alias("expected_net"), net_difference(*own, F.col("net")).cast("double").alias("difference"), "r.passed", "r.detail")


def order_of_dates(pairs: DataFrame) -> DataFrame:
    """pairs: document_id, check_name, start_date, end_date."""
    known = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    late = F.col("end_date") >= F.col("start_date")
    return pairs.select("document_id", "check_name", F.coalesce(late, F.lit(True)).alias("passed"), F.when(~known, SKIPPED).when(late, "ok").otherwise("end is before start").alias("detail"))


#: Fields that checks compare.
COMPARED = ("total_amount", "gross_pay", "net_pay", "total_deductions", *sorted({n for pair in K.DATE_PAIRS for n in pair}))


def field_values(fields: DataFrame) -> DataFrame:
    """One row a document with the value of every compared field: null where the document has no such field, an empty text
    where it has one without a value."""
    given = lambda n: F.max(F.when(F.col("name") == n, F.coalesce(F.col("value"), F.lit("")))).alias(n)
    return fields.groupBy("document_id").agg(*[given(n) for n in COMPARED])


def table_sums(cells: DataFrame) -> DataFrame:
    """(document_id, item_sum, has_deductions, deduction_sum): the first table named line_items, and the first whose name speaks of
    deductions. Cells are dealt once, by document; what a model answers for one document is bounded."""
    of_items, of_deductions = F.col("table_name") == "line_items", F.contains(F.lower("table_name"), F.lit("deduction"))
    value = lambda n: F.max(F.when(F.col("col_name") == n, F.col("value")))
    own = cells.filter(of_items | of_deductions).repartition("document_id")
    rows = own.groupBy("document_id", "table_idx", "table_name", "row_index").agg(F.coalesce(value("amount"), value("total")).alias("item"), F.coalesce(value("amount"), value("deduction_amount")).alias("deduction"))
    total = lambda c: F.try_sum(money(parse_amount(F.col(c))))
    tables = rows.groupBy("document_id", "table_idx", "table_name").agg(total("item").alias("item"), total("deduction").alias("deduction"))
    first = lambda kind, c: F.min_by(c, F.when(kind, F.col("table_idx")))
    return tables.groupBy("document_id").agg(first(of_items, "item").alias("item_sum"), F.bool_or(of_deductions).alias("has_deductions"), first(of_deductions, "deduction").alias("deduction_sum"))


def records(wide: DataFrame, doc_type: Column | None = None) -> DataFrame:
    """(document_id, RECORD…) of rows with field_values() and table_sums(), for the type of each; without one, all checks."""
    dates = sorted({n for pair in K.DATE_PAIRS for n in pair})
    of = lambda *kinds: F.lit(True) if doc_type is None else doc_type.isin(*kinds)
    # Values are read once, as columns: a record names them several times. Dates by one expression, which has many forms.
    read = wide.select(
        "document_id", of("invoice").alias("is_invoice"), of("payslip").alias("is_payslip"), of(*K.DOC_TYPES).alias("is_known"), "item_sum", "has_deductions", "deduction_sum",
        *[parse_amount(F.col(n)).alias(n) for n in COMPARED if n not in dates], *[F.col(n).isNotNull().alias(f"has_{n}") for n in dates], F.transform(F.array(*[F.col(n) for n in dates]), parse_date).alias("dates"),
    )
    read = read.withColumns({n: F.get("dates", F.lit(i)) for i, n in enumerate(dates)})
    read = read.withColumn("deductions", F.when(F.col("has_deductions"), F.col("deduction_sum")).otherwise(money(F.col("total_deductions"))))
    each = [
        F.when(F.col("is_invoice"), sum_record(F.col("item_sum"), F.col("total_amount"))),
        F.when(F.col("is_payslip"), net_record(F.col("gross_pay"), F.col("deductions"), F.col("net_pay"))),
        *[F.when(F.col("is_known") & F.col(f"has_{a}") & F.col(f"has_{b}"), date_record(a, b, F.col(a), F.col(b))) for a, b in K.DATE_PAIRS],
    ]
    return read.select("document_id", F.explode(F.array_compact(F.array(*each))).alias("c")).select("document_id", *[f"c.{n}" for n in RECORD])


def _wide(fields: DataFrame, cells: DataFrame) -> DataFrame:
    return field_values(fields).join(table_sums(cells), "document_id", "left")


def line_items_check(fields: DataFrame, cells: DataFrame) -> DataFrame:
    return records(_wide(fields, cells)).filter("check_name = 'line_items_sum_vs_total'")


def deductions_check(fields: DataFrame, cells: DataFrame) -> DataFrame:
    """A table of deductions counts even if none of its amounts can be read; only without one does the total field."""
    return records(_wide(fields, cells)).filter("check_name = 'deductions_vs_net_pay'")


def cross_checks(documents: DataFrame, fields: DataFrame, cells: DataFrame) -> DataFrame:
    """documents (document_id, doc_type): the records of the checks of each type; an unknown type has none. Fields and cells are
    gone through once; three exchanges by document, no other."""
    return records(documents.select("document_id", "doc_type").join(_wide(fields, cells), "document_id"), F.col("doc_type"))


def font_flags(fields: DataFrame, words: DataFrame, strokes: DataFrame | None = None) -> DataFrame:
    """Fields (document_id, name, x, y, width, height) whose letters differ in height, or in stroke where strokes
    (document_id, name, stroke, stroke_mean, stroke_std) are given, from those of the document's words. With strokes only fields that
    have one, those on the picture, are compared."""
    high = words.filter(F.col("height") >= K.FONT_LEAST_HEIGHT)
    # Heights are whole pixels: sums and sums of squares are exact.
    base = high.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("height").cast("long")).alias("s1"), F.sum(F.col("height").cast("long") * F.col("height")).alias("s2")).filter(F.col("n") >= K.FONT_LEAST_WORDS)
    variance = (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("n") * F.col("n"))
    base = base.select("document_id", (F.col("s1") / F.col("n")).alias("mean_height"), F.greatest(F.sqrt(variance), F.lit(K.FONT_STD_FLOOR)).alias("std_height"))
    boxes = fields.filter("width >= 8 and height >= 8").select("document_id", "name", *[F.greatest(F.col(c), F.lit(0)).alias(c) for c in ("x", "y")], "width", "height")
    w = words.select("document_id", F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("height").alias("wh"))
    inside = F.col("wx").between(F.col("x"), F.col("x") + F.col("width")) & F.col("wy").between(F.col("y"), F.col("y") + F.col("height"))
    own = boxes.join(w, "document_id").filter(inside).groupBy("document_id", "name").agg((F.sum(F.col("wh").cast("long")) / F.count(F.lit(1))).alias("own_height"))
    out = boxes.join(base, "document_id").join(own, ["document_id", "name"], "left").withColumn("own_height", F.coalesce("own_height", F.col("height").cast("double")))
    z = F.abs(F.col("own_height") - F.col("mean_height")) / F.col("std_height")
    stroke_z = F.lit(0.0)
    if strokes is not None:
        out = out.join(strokes, ["document_id", "name"])
        stroke_z = F.when(F.col("stroke") > K.STROKE_LEAST, F.abs(F.col("stroke") - F.coalesce("stroke_mean", F.lit(K.STROKE_MEAN))) / F.when(F.col("stroke_mean").isNull(), K.STROKE_STD).otherwise(F.greatest("stroke_std", F.lit(K.STROKE_STD_FLOOR)))).otherwise(0.0)
    out = out.withColumn("z", F.greatest(z, stroke_z)).withColumn("by_height", z >= stroke_z)
    kind = F.when(F.col("by_height"), F.when(F.col("own_height") > F.col("mean_height"), "larger").otherwise("smaller"))
    if strokes is not None:
        kind = kind.otherwise(F.when(F.col("stroke") > F.coalesce("stroke_mean", F.lit(K.STROKE_MEAN)), "heavier").otherwise("thinner"))
    severity = F.when(F.col("z") >= K.FONT_Z_HIGH, "high").when(F.col("z") >= K.FONT_Z_MEDIUM, "medium").otherwise("low")
    return out.filter(F.col("z") > K.FONT_Z).select("document_id", F.lit("font_inconsistency").alias("flag_type"), F.col("name").alias("affected_field"), kind.alias("evidence"), severity.alias("severity"))


def recompression_flags(measures: DataFrame) -> DataFrame:
    """measures (document_id, page, resave_mean, resave_percent): first pages of which too many pixels change when saved again."""
    said = F.format_string("saved again, %.2f %% of the pixels change strongly (mean change %.2f)", "resave_percent", "resave_mean")
    found = measures.filter((F.col("page") == 1) & (F.col("resave_percent") > K.RESAVE_PERCENT))
    return found.select("document_id", F.lit("recompression_artifact").alias("flag_type"), F.lit(None).cast("string").alias("affected_field"), said.alias("evidence"), F.lit("medium").alias("severity"))


def metadata_flags(meta: DataFrame) -> DataFrame:
    """meta: document_id, created, modified (timestamps), software. Gaps and clock skew between the two, and
    editing software; a document may have one flag of each sort."""
    gap = (F.unix_micros("modified") - F.unix_micros("created")) / 86_400_000_000
    late = F.when(gap > K.LARGE_GAP_DAYS, "high").when(gap > K.GAP_DAYS, "medium").when(gap < K.CLOCK_SKEW_DAYS, "high")
    what = F.when(gap > K.GAP_DAYS, "modified long after creation").when(gap < K.CLOCK_SKEW_DAYS, "modified before creation")
    tool = F.get(F.filter(F.array(*[F.lit(k) for k in K.EDITING_SOFTWARE]), lambda k: F.contains(F.lower("software"), k)), F.lit(0))
    flags = F.array_compact(F.array(
        F.when(late.isNotNull(), F.struct(what.alias("evidence"), late.alias("severity"))),
        F.when(tool.isNotNull(), F.struct(F.concat(F.lit("editing software: "), tool).alias("evidence"), F.lit("high").alias("severity"))),
    ))
    return meta.select("document_id", F.explode(flags).alias("f")).select("document_id", F.lit("metadata_mismatch").alias("flag_type"), F.lit(None).cast("string").alias("affected_field"), "f.evidence", "f.severity")
