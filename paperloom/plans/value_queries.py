"""Queries of amounts, dates, rules, masks and business checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.functions.scores import cell_score, combine, crop, is_personal, word_colour
from paperloom.functions.text import doc_type_label, expected_type, infer_type, mask_value, nullish, snippet
from paperloom.functions.values import exif_date, iso_date, mean4, parse_amount, parse_date, pdf_date, rule_passed, units
from paperloom.operators import checks, scoring
from paperloom.plans.catalog import register, table


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def contains_any(value: str, words) -> str:
    return "(" + " OR ".join(f"contains({value}, '{w}')" for w in words) + ")"


@register("line_items_sum_check", """
WITH items AS (SELECT l_orderkey, round(sum(CAST(l_extendedprice AS DECIMAL(28,6))), 2) AS s FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, s, s + (o_orderkey % 5 - 2) * CAST(0.75 AS DECIMAL(28,6)) AS total FROM orders LEFT JOIN items ON o_orderkey = l_orderkey)
SELECT o_orderkey AS document_id, 'line_items_sum_vs_total' AS check_name, CAST(s AS DOUBLE) AS item_sum,
  CAST(round(abs(s - total), 2) AS DOUBLE) AS difference, coalesce(round(abs(s - total), 2) <= 1.0, true) AS passed,
  CASE WHEN s IS NULL THEN 'skipped' WHEN round(abs(s - total), 2) <= 1.0 THEN 'ok' ELSE 'sum differs from total' END AS detail
FROM d
""")
def line_items_sum_check(spark, d):
    """Orders as invoices; the declared total is off by -1.5 to 1.5, so that checks pass, fail and are skipped."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_extendedprice").alias("amount"))
    sums = items.groupBy("document_id").agg(F.round(F.sum(F.col("amount").cast(checks.MONEY)), 2).alias("s"))
    offset = (F.col("o_orderkey") % 5 - 2) * F.lit(0.75).cast(checks.MONEY)
    declared = table(spark, d, "orders").select("o_orderkey").join(sums, F.col("o_orderkey") == F.col("document_id"), "left")
    return checks.sum_check(declared.select(F.col("o_orderkey").alias("document_id"), (F.col("s") + offset).alias("total")), items)


@register("deductions_vs_net", """
WITH p AS (SELECT l_orderkey AS document_id, sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS gross,
    sum(CAST(round(CAST(l_extendedprice AS DECIMAL(28,6)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(28,6))) AS ded FROM lineitem GROUP BY 1),
q AS (SELECT document_id, round(gross - ded, 2) AS expected, round(gross - ded, 2) + (document_id % 5 - 2) * CAST(0.75 AS DECIMAL(28,6)) AS net FROM p)
SELECT document_id, 'deductions_vs_net_pay' AS check_name, CAST(expected AS DOUBLE) AS expected_net, CAST(round(abs(expected - net), 2) AS DOUBLE) AS difference,
  round(abs(expected - net), 2) <= 1.0 AS passed, CASE WHEN round(abs(expected - net), 2) <= 1.0 THEN 'ok' ELSE 'gross less deductions differs from net' END AS detail
FROM q
""")
def deductions_vs_net(spark, d):
    """Order lines as a payslip: price is gross, discounts are deductions."""
    price = F.col("l_extendedprice").cast(checks.MONEY)
    cut = F.round(price * F.col("l_discount").cast("decimal(4,2)"), 2).cast(checks.MONEY)
    pay = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.sum(price).alias("gross"), F.sum(cut).alias("deductions"))
    net = F.round(F.col("gross") - F.col("deductions"), 2) + (F.col("document_id") % 5 - 2) * F.lit(0.75).cast(checks.MONEY)
    return checks.net_pay_check(pay.withColumn("net", net))


@register("date_chronology", """
SELECT o_orderkey AS document_id, 'order_vs_ship_chronology' AS check_name, coalesce(min(CAST(l_shipdate AS DATE)) >= CAST(o_orderdate AS DATE), true) AS passed,
  CASE WHEN min(l_shipdate) IS NULL THEN 'skipped' WHEN min(CAST(l_shipdate AS DATE)) >= CAST(o_orderdate AS DATE) THEN 'ok' ELSE 'end is before start' END AS detail
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate
""")
def date_chronology(spark, d):
    shipped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_shipdate").cast("date")).alias("end_date"))
    pairs = table(spark, d, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return checks.order_of_dates(pairs.select(F.col("o_orderkey").alias("document_id"), F.lit("order_vs_ship_chronology").alias("check_name"), F.col("o_orderdate").cast("date").alias("start_date"), "end_date"))


INVOICE_FIELDS = """
SELECT o_orderkey AS document_id, CASE o_orderkey % 5 WHEN 0 THEN 'invoice' WHEN 1 THEN 'payslip' WHEN 2 THEN 'id_proof' WHEN 3 THEN 'bank_statement' ELSE 'other' END AS doc_type, o_orderdate FROM orders
"""


@register("cross_checks_dispatch", f"""
WITH d AS ({INVOICE_FIELDS}),
items AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS s FROM lineitem GROUP BY 1),
t AS (SELECT d.*, s, round(s, 0) AS stated FROM d LEFT JOIN items ON document_id = l_orderkey)
SELECT document_id, 'line_items_sum_vs_total' AS check_name, coalesce(round(abs(round(s, 2) - stated), 2) <= 1.0, true) AS passed,
  CASE WHEN s IS NULL THEN 'skipped' WHEN round(abs(round(s, 2) - stated), 2) <= 1.0 THEN 'ok' ELSE 'sum differs from total' END AS detail FROM t WHERE doc_type = 'invoice'
UNION ALL SELECT document_id, 'deductions_vs_net_pay', coalesce(round(abs(round(stated - s, 2) - stated), 2) <= 1.0, true),
  CASE WHEN s IS NULL THEN 'skipped' WHEN round(abs(round(stated - s, 2) - stated), 2) <= 1.0 THEN 'ok' ELSE 'gross less deductions differs from net' END FROM t WHERE doc_type = 'payslip'
UNION ALL SELECT document_id, 'issue_date_vs_expiry_date_chronology', document_id % 3 <> 0, CASE WHEN document_id % 3 <> 0 THEN 'ok' ELSE 'end is before start' END FROM t
""")
def cross_checks_dispatch(spark, d):
    """Each order as a document of one of five types with fields and a table, through the checks of its type."""
    return checks.cross_checks(*papers(spark, d)).select("document_id", "check_name", "passed", "detail")


def papers(spark, d, off: float = 0.0):
    """Orders as documents, their fields and their cells; stated amounts are off by up to three times `off`."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in K.DOC_TYPES]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), kinds.alias("doc_type"), F.col("o_orderdate").cast("date").alias("day"))
    lines = table(spark, d, "lineitem")
    sums = lines.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.round(F.sum(F.col("l_extendedprice").cast(checks.MONEY)), 0).alias("stated"))
    sums = sums.withColumn("stated", F.col("stated") + (F.col("document_id") % 7 - 3) * F.lit(off).cast(checks.MONEY))
    stated = F.col("stated").cast("string")
    pairs = docs.join(sums, "document_id", "left").select("document_id", F.explode(F.array(
        F.struct(F.lit("total_amount").alias("name"), stated.alias("value")),
        F.struct(F.lit("gross_pay").alias("name"), stated.alias("value")),
        F.struct(F.lit("net_pay").alias("name"), stated.alias("value")),
        F.struct(F.lit("issue_date").alias("name"), F.date_format("day", "dd/MM/yyyy").alias("value")),
        F.struct(F.lit("expiry_date").alias("name"), F.date_format(F.date_add("day", F.when(F.col("document_id") % 3 == 0, -1).otherwise(365)), "MMM d, yyyy").alias("value")),
    )).alias("f")).select("document_id", "f.name", "f.value")
    named = F.when(F.col("l_orderkey") % 5 == 1, "Deductions").otherwise("line_items")
    # Rows of a table by number: lines of an order may repeat in every column, so equal ones are numbered too.
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    cells = lines.select(F.col("l_orderkey").alias("document_id"), F.lit(0).alias("table_idx"), named.alias("table_name"), row.alias("row_index"), F.lit("amount").alias("col_name"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("value"))
    return docs, pairs, cells


@register("check_records", f"""
WITH d AS ({INVOICE_FIELDS}),
items AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS s FROM lineitem GROUP BY 1),
t AS (SELECT d.*, s, CAST(s AS DECIMAL(28,2)) AS s2, round(s, 0) + (document_id % 7 - 3) * CAST(0.75 AS DECIMAL(28,6)) AS stated FROM d LEFT JOIN items ON document_id = l_orderkey),
sums AS (SELECT document_id, 'line_items_sum_vs_total' AS check_name, 'line_items.amount,total_amount' AS fields_compared, 'the sum of line_items.amount is total_amount, give or take 1.00' AS expected_relationship, s IS NOT NULL AS known,
  round(abs(round(s, 2) - stated), 2) AS diff, 'sum differs from total' AS failure, 'items add up to ' || s2 || ', total_amount is ' || CAST(stated AS DECIMAL(28,2)) AS figures FROM t WHERE doc_type = 'invoice'
UNION ALL SELECT document_id, 'deductions_vs_net_pay', 'gross_pay,deductions.amount,net_pay', 'gross_pay less the sum of deductions is net_pay, give or take 1.00', s IS NOT NULL,
  round(abs(round(stated - s, 2) - stated), 2), 'gross less deductions differs from net', 'gross_pay less deductions is ' || CAST(round(stated - s, 2) AS DECIMAL(28,2)) || ', net_pay is ' || CAST(stated AS DECIMAL(28,2)) FROM t WHERE doc_type = 'payslip')
SELECT document_id, check_name, fields_compared, expected_relationship, NOT known OR diff <= 1.0 AS passed, CASE WHEN NOT known THEN 'skipped' WHEN diff <= 1.0 THEN 'ok' ELSE failure END AS detail,
  CASE WHEN NOT known THEN 'skipped: fields are missing or cannot be read' WHEN diff > 1.0 THEN figures || ': ' || CAST(diff AS DECIMAL(28,2)) || ' apart' END AS discrepancy FROM sums
UNION ALL SELECT document_id, 'issue_date_vs_expiry_date_chronology', 'issue_date,expiry_date', 'expiry_date is not before issue_date', document_id % 3 <> 0, CASE WHEN document_id % 3 <> 0 THEN 'ok' ELSE 'end is before start' END,
  CASE WHEN document_id % 3 = 0 THEN 'expiry_date ' || CAST(CAST(o_orderdate AS DATE) - 1 AS VARCHAR) || ' is before issue_date ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END FROM t
""")
def check_records(spark, d):
    """As cross_checks_dispatch, with totals that are off by up to 2.25: the whole records, with what is compared and by how much it fails."""
    return checks.cross_checks(*papers(spark, d, 0.75)).withColumn("fields_compared", F.array_join("fields_compared", ","))


ISO_TEXTS = "CASE o_orderkey % 8 WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+05:30') WHEN 2 THEN strftime(t, '%Y-%m-%d') WHEN 3 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 4 THEN strftime(t, '%Y-%m-%dT%H:%M:%S.250000-08:00') WHEN 5 THEN strftime(t, '%Y-%m-%dT%H:%M') WHEN 6 THEN strftime(t, '%d/%m/%Y') ELSE '' END"


@register("iso_dates", f"""
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey * 977 % 86400) AS t FROM orders),
x AS (SELECT o_orderkey, {ISO_TEXTS} AS s FROM t)
SELECT o_orderkey AS id, s AS iso_text, CASE WHEN o_orderkey % 8 < 6 THEN epoch_us(CAST(CASE o_orderkey % 8 WHEN 2 THEN s || ' 00:00:00+00:00' WHEN 3 THEN s || '+00:00' WHEN 5 THEN s || ':00+00:00' ELSE s END AS TIMESTAMPTZ)) END AS micros FROM x
""")
def iso_dates(spark, d):
    """Times with Z, with offsets, without either (UTC), dates alone, and texts that are none."""
    k = F.col("o_orderkey")
    t = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + k * 977 % 86400 * 1_000_000)
    form = lambda f: F.date_format(t, f)
    text = F.when(k % 8 == 0, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 8 == 1, form("yyyy-MM-dd'T'HH:mm:ss'+05:30'")).when(k % 8 == 2, form("yyyy-MM-dd")).when(k % 8 == 3, form("yyyy-MM-dd HH:mm:ss"))
    text = text.when(k % 8 == 4, form("yyyy-MM-dd'T'HH:mm:ss'.250000-08:00'")).when(k % 8 == 5, form("yyyy-MM-dd'T'HH:mm")).when(k % 8 == 6, form("dd/MM/yyyy")).otherwise("")
    return table(spark, d, "orders").select(k.alias("id"), text.alias("iso_text")).withColumn("micros", F.unix_micros(iso_date(F.col("iso_text"))))


@register("parse_amount", """
SELECT o_orderkey AS id, TRY_CAST(regexp_replace(t, '[^0-9.-]', '', 'g') AS DOUBLE) AS amount FROM (
  SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '$' || p WHEN 1 THEN 'USD ' || p WHEN 2 THEN '(' || p || ')' WHEN 3 THEN 'Rs. ' || p WHEN 4 THEN p || '-' ELSE 'n/a' END AS t
  FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders))
""")
def q_parse_amount(spark, d):
    p, k = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderkey") % 6
    text = F.when(k == 0, F.concat(F.lit("$"), p)).when(k == 1, F.concat(F.lit("USD "), p)).when(k == 2, F.concat(F.lit("("), p, F.lit(")"))).when(k == 3, F.concat(F.lit("Rs. "), p)).when(k == 4, F.concat(p, F.lit("-"))).otherwise("n/a")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parse_amount(text).alias("amount"))


DATE_TEXTS = "CASE o_orderkey % 8 WHEN 0 THEN strftime(t, '%Y-%m-%d') WHEN 1 THEN strftime(t, '%d/%m/%Y') WHEN 2 THEN strftime(t, '%d-%m-%Y') WHEN 3 THEN strftime(t, '%Y/%m/%d') WHEN 4 THEN strftime(t, '%d %b %Y') WHEN 5 THEN strftime(t, '%B %d, %Y') WHEN 6 THEN strftime(t, '%Y%m%d') ELSE strftime(t, '%d.%m.%Y') END"


def _date_text():
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    out = None
    for i, form in enumerate(("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd MMM yyyy", "MMMM dd, yyyy", "yyyyMMdd", "dd.MM.yyyy")):
        text = F.date_format(t, form)
        out = F.when(k == i, text) if out is None else out.when(k == i, text)
    return out


@register("parse_date", f"""
WITH s AS (SELECT o_orderkey AS id, {DATE_TEXTS} AS s FROM (SELECT o_orderkey, o_orderdate AS t FROM orders))
SELECT id, strftime(try_strptime(replace(replace(s, ',', ''), '.', ''), ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%Y/%m/%d', '%d %b %Y', '%d %B %Y', '%b %d %Y', '%B %d %Y', '%Y%m%d']), '%Y-%m-%d') AS day, true AS rule FROM s
""")
def q_parse_date(spark, d):
    """Order dates written in eight forms; the dotted one cannot be read but looks like a date."""
    text = _date_text()
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parse_date(text).cast("string").alias("day"), rule_passed(text, F.lit("date")).alias("rule"))


@register("ambiguous_dates", """
SELECT o_orderkey AS id, strftime(CASE WHEN m <= 12 THEN make_date(y, m, d) ELSE make_date(y, d, m) END, '%Y-%m-%d') AS day FROM (
  SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS d, CAST(o_orderkey % 27 + 1 AS BIGINT) AS m FROM orders WHERE o_orderkey % 27 < 27)
""")
def ambiguous_dates(spark, d):
    """a/b/year: the day comes first where that can be, else the month."""
    text = F.concat_ws("/", F.month("o_orderdate").cast("string"), (F.col("o_orderkey") % 27 + 1).cast("string"), F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parse_date(text).cast("string").alias("day"))


@register("metadata_dates", """
SELECT o_orderkey AS id, CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) AS pdf, CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) AS exif FROM orders
""")
def metadata_dates(spark, d):
    """Times in the forms of PDF and EXIF metadata, read back."""
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        pdf_date(F.concat(F.lit("D:"), F.date_format(t, "yyyyMMddHHmmss"), F.lit("+05'30'"))).cast("timestamp_ntz").alias("pdf"),
        exif_date(F.date_format(t, "yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz").alias("exif"),
    )


VALUE_KINDS = """SELECT c_custkey AS id, k, CASE k WHEN 'name' THEN CASE WHEN c_custkey % 7 = 0 THEN '1' ELSE c_name END WHEN 'amount' THEN CASE WHEN c_custkey % 5 = 0 THEN '(' || a || ')' ELSE 'USD ' || a END
  WHEN 'id_number' THEN CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE CAST(c_custkey AS VARCHAR) || '-' || CAST(c_nationkey AS VARCHAR) END ELSE CASE WHEN c_custkey % 11 = 0 THEN ' None ' ELSE c_mktsegment END END AS v
  FROM (SELECT *, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS a FROM customer), (VALUES ('name'), ('amount'), ('id_number'), ('text')) kinds(k)"""


def _value_kinds(spark, d):
    key, a = F.col("c_custkey"), F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    each = {
        "name": F.when(key % 7 == 0, "1").otherwise(F.col("c_name")),
        "amount": F.when(key % 5 == 0, F.concat(F.lit("("), a, F.lit(")"))).otherwise(F.concat(F.lit("USD "), a)),
        "id_number": F.when(key % 3 == 0, "-").otherwise(F.concat_ws("-", key.cast("string"), F.col("c_nationkey").cast("string"))),
        "text": F.when(key % 11 == 0, " None ").otherwise(F.col("c_mktsegment")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in each.items()]))
    return table(spark, d, "customer").select(key.alias("id"), rows.alias("r")).select("id", "r.k", "r.v")


@register("rule_checks", f"""
WITH x AS ({VALUE_KINDS})
SELECT id, k, v, CASE WHEN lower(trim(v)) IN ('null', 'none', '') THEN false WHEN k = 'name' THEN length(trim(v)) BETWEEN 2 AND 100 AND regexp_matches(v, '[A-Za-z]')
  WHEN k = 'amount' THEN TRY_CAST(regexp_replace(regexp_replace(v, '[$₹€£¥,\\s]', '', 'g'), 'USD', '', 'g') AS DOUBLE) IS NOT NULL
  WHEN k = 'id_number' THEN length(v) >= 2 AND regexp_matches(v, '[A-Za-z0-9]') ELSE true END AS passed FROM x
""")
def rule_checks(spark, d):
    return _value_kinds(spark, d).withColumn("passed", rule_passed(F.col("v"), F.col("k")))


@register("mask_values", f"""
WITH x AS ({VALUE_KINDS}), b AS (SELECT *, trim(v) AS s, regexp_replace(trim(v), '[\\s-]', '', 'g') AS bare FROM x)
SELECT id, k, CASE WHEN lower(s) IN ('null', 'none', '') THEN s WHEN k = 'id_number' THEN 'XXXX-XXXX-' || right(bare, 4)
  WHEN k = 'name' AND contains(s, ' ') THEN array_to_string(list_transform(regexp_split_to_array(s, '\\s+'), lambda w: left(w, 1) || repeat('*', greatest(length(w) - 1, 3))), ' ')
  WHEN k = 'name' THEN left(s, 1) || repeat('*', greatest(length(s) - 1, 6))
  WHEN k = 'amount' THEN regexp_extract(s, '^([$₹€£¥A-Z]{{1,3}}\\s*)', 1) || '**,***.**'
  WHEN length(s) <= 4 THEN repeat('*', length(s)) ELSE left(s, 1) || repeat('*', length(s) - 2) || right(s, 1) END AS masked FROM b
""")
def mask_values(spark, d):
    return _value_kinds(spark, d).select("id", "k", mask_value(F.col("v"), F.col("k")).alias("masked"))


@register("nullish_filter", f"""
WITH x AS ({VALUE_KINDS}) SELECT k, count(*) FILTER (WHERE lower(trim(v)) IN ('null', 'none', '')) AS n_skipped, count(*) FILTER (WHERE lower(trim(v)) NOT IN ('null', 'none', '')) AS n_kept FROM x GROUP BY k
""")
def nullish_filter(spark, d):
    gone = nullish(F.col("v"))
    return _value_kinds(spark, d).groupBy("k").agg(F.count_if(gone).alias("n_skipped"), F.count_if(~gone).alias("n_kept"))


FIELD_NAMES = ("payment_date", "issuer_name", "tax_id", "employee_id", "customer_name", "width", "memo", "vendor", "account", "note")


@register("infer_types", f"""
WITH f AS (SELECT p_partkey AS id, ([{quoted(FIELD_NAMES)}])[CAST(p_partkey % 10 AS INT) + 1] AS name,
  CASE WHEN p_partkey % 3 = 0 THEN '$' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) WHEN p_partkey % 3 = 1 THEN '2024/1/' || CAST(p_size % 28 + 1 AS VARCHAR) ELSE p_name END AS v FROM part)
SELECT id, name, CASE {' '.join(f"WHEN {contains_any('name', w)} THEN '{k}'" for k, w in K.NAME_HINTS)}
  WHEN regexp_matches(lower(v), '{K.AMOUNT_VALUE}') THEN 'amount' WHEN regexp_matches(lower(v), '{K.DATE_VALUE}') THEN 'date' ELSE 'text' END AS field_type FROM f
""")
def infer_types(spark, d):
    key = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(n) for n in FIELD_NAMES]), (key % 10 + 1).cast("int"))
    value = F.when(key % 3 == 0, F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"))).when(key % 3 == 1, F.concat(F.lit("2024/1/"), (F.col("p_size") % 28 + 1).cast("string"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(key.alias("id"), name.alias("name"), infer_type(name, value).alias("field_type"))


@register("schema_lookup", f"""
WITH s(t, f, k) AS (VALUES {', '.join(f"('{t}', '{f}', '{k}')" for t, x in K.SCHEMAS.items() for f, k in x['fields'].items())}),
n AS (SELECT p_partkey AS id, ([{quoted(K.DOC_TYPES)}])[CAST(p_partkey % 5 AS INT) + 1] AS doc_type, ([{quoted(("total_amount", "address", "pay_period", "closing_balance", "colour"))}])[CAST(p_partkey // 5 % 5 AS INT) + 1] AS name FROM part)
SELECT id, doc_type, name, coalesce(k, CASE name WHEN 'total_amount' THEN 'amount' WHEN 'address' THEN 'text' WHEN 'pay_period' THEN 'date' WHEN 'closing_balance' THEN 'amount' ELSE 'text' END) AS field_type
FROM n LEFT JOIN s ON t = doc_type AND f = name
""")
def schema_lookup(spark, d):
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in K.DOC_TYPES]), (key % 5 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(n) for n in ("total_amount", "address", "pay_period", "closing_balance", "colour")]), (F.floor(key / 5) % 5 + 1).cast("int"))
    return table(spark, d, "part").select(key.alias("id"), kind.alias("doc_type"), name.alias("name"), expected_type(kind, name, F.lit("x")).alias("field_type"))


@register("doc_type_labels", f"""
WITH t AS (SELECT event_id AS id, regexp_replace(lower(trim(([{quoted(("Invoice.", "**payslip**", "bank statement", " id_proof", "BANK_STATEMENT", "letter"))}])[CAST(event_id % 6 AS INT) + 1])), '[^a-z_]', '', 'g') AS c FROM events)
SELECT id, CASE WHEN c IN ({quoted(K.DOC_TYPES)}) THEN c ELSE 'other' END AS doc_type FROM t
""")
def doc_type_labels(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Invoice.", "**payslip**", "bank statement", " id_proof", "BANK_STATEMENT", "letter")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), doc_type_label(raw).alias("doc_type"))


SCORE_INPUTS = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS dc, CAST(round(l_tax * 100) AS BIGINT) AS tx FROM lineitem"


@register("combine_confidence", f"""
WITH i AS (SELECT q, dc, tx, q * 2 AS ocr, CASE WHEN tx % 3 = 0 THEN NULL ELSE dc * 10 END AS llm, q % 4 <> 0 AS rule FROM ({SCORE_INPUTS})),
s AS (SELECT *, CASE WHEN llm IS NOT NULL THEN (40 * ocr + 40 * llm + CASE WHEN rule THEN 2000 ELSE 0 END) * 1.0 / 100 ELSE (40 * ocr + CASE WHEN rule THEN 2000 ELSE 0 END) / 60.0 END AS u FROM i),
c AS (SELECT *, CASE WHEN rule THEN u ELSE least(u, 50.0) END AS w FROM s)
SELECT ocr / 100.0 AS ocr, llm / 100.0 AS llm, rule, floor(w * 100 + 0.5) / 10000 AS score, CASE WHEN floor(w * 100 + 0.5) >= 7500 THEN 'green' WHEN floor(w * 100 + 0.5) >= 4000 THEN 'amber' ELSE 'red' END AS bucket, count(*) AS n
FROM c GROUP BY ALL
""")
def combine_confidence(spark, d):
    lines = table(spark, d, "lineitem")
    q, dc, tx = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long")
    ocr, llm, rule = (q * 2) / 100.0, F.when(tx % 3 != 0, dc * 10 / 100.0), q % 4 != 0
    out = lines.select(ocr.alias("ocr"), llm.alias("llm"), rule.alias("rule"), combine(ocr, llm, rule).alias("c"))
    return out.groupBy("ocr", "llm", "rule", F.col("c.combined_score").alias("score"), F.col("c.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("table_confidence", f"""
WITH c AS (SELECT l_orderkey, CASE WHEN q % 5 = 0 THEN NULL ELSE q * 200 END AS ocr, q % 7 <> 0 AS full_ FROM ({SCORE_INPUTS})),
s AS (SELECT l_orderkey, CASE WHEN full_ THEN (coalesce(ocr, 8000) * 7 + 30000) // 10 ELSE least((coalesce(ocr, 8000) * 7) // 10, 5000) END AS u FROM c)
SELECT l_orderkey AS document_id, floor((2 * sum(u) + count(*)) / (2 * count(*))) / 10000.0 AS table_confidence FROM s GROUP BY 1
""")
def table_confidence(spark, d):
    """Cell scores from made-up word confidences, averaged over each order's lines."""
    q = F.col("l_quantity").cast("long")
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(0).alias("table_idx"), F.when(q % 5 != 0, q * 2 / 100.0).alias("ocr_confidence"), F.when(q % 7 != 0, F.col("l_returnflag")).alias("value"))
    return scoring.score_tables(scoring.score_cells(cells)).drop("table_idx")


@register("personal_fields", f"""
WITH n AS (SELECT p_partkey AS id, lower(replace(p_name, ' ', '_')) || CASE p_partkey % 4 WHEN 0 THEN '_iban' WHEN 1 THEN '_company' WHEN 2 THEN '_className' ELSE '' END AS name, CASE WHEN p_partkey % 6 = 0 THEN 'id_number' ELSE 'text' END AS k FROM part)
SELECT id, name, k = 'id_number' OR {contains_any('lower(name)', K.PERSONAL_NAMES)} AS personal FROM n
""")
def personal_fields(spark, d):
    """Names are searched as they are: company holds pan, className holds ssn."""
    key = F.col("p_partkey")
    tail = F.when(key % 4 == 0, "_iban").when(key % 4 == 1, "_company").when(key % 4 == 2, "_className").otherwise("")
    name = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), tail)
    return table(spark, d, "part").select(key.alias("id"), name.alias("name"), is_personal(name, F.when(key % 6 == 0, "id_number").otherwise("text")).alias("personal"))


@register("crop_rectangles", """
WITH b AS (SELECT p_partkey AS id, CAST(p_partkey % 300 - 20 AS BIGINT) AS x, CAST(p_partkey % 170 AS BIGINT) AS y, CAST(p_size - 3 AS BIGINT) AS w, CAST(p_size AS BIGINT) AS h FROM part)
SELECT id, greatest(0, x - 10) AS l, greatest(0, y - 10) AS t, least(250, x + w + 10) AS r, least(150, y + h + 10) AS b FROM b
WHERE w > 0 AND h > 0 AND x < 250 AND y < 150 AND least(250, x + w + 10) > greatest(0, x - 10) AND least(150, y + h + 10) > greatest(0, y - 10)
""")
def crop_rectangles(spark, d):
    key = F.col("p_partkey")
    c = crop(key % 300 - 20, key % 170, (F.col("p_size") - 3).cast("long"), F.col("p_size").cast("long"), F.lit(250).cast("long"), F.lit(150).cast("long"))
    return table(spark, d, "part").select(key.alias("id"), c.alias("c")).filter("c is not null").selectExpr("id", "c.left l", "c.top t", "c.right r", "c.bottom b")


@register("word_colours", """
SELECT CASE WHEN l_discount * 10 >= 0.8 THEN 'green' WHEN l_discount * 10 >= 0.6 THEN 'amber' ELSE 'red' END AS colour, count(*) AS n FROM lineitem GROUP BY 1
""")
def word_colours(spark, d):
    return table(spark, d, "lineitem").groupBy(word_colour(F.col("l_discount") * 10).alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@register("snippets", """
WITH s AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS snippet FROM s
""")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


@register("metadata_gap", """
WITH g AS (SELECT user_id, min(ts) AS c, CASE WHEN user_id % 3 = 0 THEN min(ts) - INTERVAL 1 HOUR WHEN user_id % 3 = 1 THEN min(ts) + INTERVAL 1 HOUR * (user_id % 500) ELSE max(ts) END AS m,
  CASE WHEN user_id % 4 = 0 THEN 'Adobe Photoshop 25' WHEN user_id % 4 = 1 THEN 'Paint.NET 5' ELSE 'report writer' END AS s FROM events GROUP BY user_id),
f AS (SELECT *, (epoch_us(m) - epoch_us(c)) / 86400000000.0 AS gap FROM g)
SELECT user_id AS document_id, 'metadata_mismatch' AS flag_type, CAST(NULL AS VARCHAR) AS affected_field, CASE WHEN gap > 1 THEN 'modified long after creation' ELSE 'modified before creation' END AS evidence, CASE WHEN gap > 14 OR gap < -0.01 THEN 'high' ELSE 'medium' END AS severity FROM f WHERE gap > 1 OR gap < -0.01
UNION ALL SELECT user_id, 'metadata_mismatch', NULL, 'editing software: ' || CASE user_id % 4 WHEN 0 THEN 'photoshop' ELSE 'paint' END, 'high' FROM f WHERE user_id % 4 IN (0, 1)
""")
def metadata_gap(spark, d):
    u = F.col("user_id")
    g = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("created"), F.max("ts").alias("last"))
    moved = F.when(u % 3 == 0, F.expr("created - interval 1 hour")).when(u % 3 == 1, F.expr("created + make_interval(0, 0, 0, 0, cast(user_id % 500 as int))")).otherwise(F.col("last"))
    software = F.when(u % 4 == 0, "Adobe Photoshop 25").when(u % 4 == 1, "Paint.NET 5").otherwise("report writer")
    utc = lambda c: c.cast("timestamp")
    return checks.metadata_flags(g.select(u.alias("document_id"), utc(F.col("created")).alias("created"), utc(moved).alias("modified"), software.alias("software")))
