"""Queries of the store, review, sensitivity and retrieval over events, customers and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.functions.scores import bucket
from paperloom.operators import display, extraction, privacy, retrieval, review, scoring, store
from paperloom.plans.catalog import register, table


def fields_of(spark, d):
    """Six fields of each customer, as of a document of one of five types."""
    key = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in K.DOC_TYPES]), (key % 5 + 1).cast("int"))
    each = (
        ("vendor_name", F.col("c_name"), F.lit("name"), F.lit(1)),
        ("invoice_number", key.cast("string"), F.when(key % 2 == 0, "id_number").otherwise("text"), F.lit(2)),
        ("iban", F.when(key % 3 == 0, F.concat(F.lit("DE"), key.cast("string"))), F.lit("text"), F.lit(3)),
        ("tax_id", F.when(key % 4 == 0, F.concat(F.lit("T"), key.cast("string"))), F.lit("text"), F.lit(4)),
        ("segment", F.col("c_mktsegment"), F.lit("text"), F.lit(5)),
    )
    rows = F.explode(F.array(*[F.struct(p.alias("pos"), F.lit(n).alias("name"), v.alias("value"), t.alias("field_type")) for n, v, t, p in each]))
    out = table(spark, d, "customer").select(key.alias("document_id"), kind.alias("doc_type"), F.abs(F.round(F.col("c_acctbal") * 100)).cast("long").alias("cents"), rows.alias("f"))
    score = ((F.col("cents") * (F.col("f.pos") + 1)) % 101) / 100.0
    return out.select("document_id", "doc_type", "f.*", score.alias("combined_score"), bucket(score).alias("bucket"), F.lit(False).alias("manually_corrected")).filter("value is not null")


FIELDS_SQL = f"""
fields AS (SELECT *, CASE WHEN combined_score >= 0.75 THEN 'green' WHEN combined_score >= 0.4 THEN 'amber' ELSE 'red' END AS bucket FROM (
  SELECT c_custkey AS document_id, ([{', '.join(f"'{t}'" for t in K.DOC_TYPES)}])[CAST(c_custkey % 5 AS INT) + 1] AS doc_type, pos, name, value, field_type, ((CAST(abs(round(c_acctbal * 100)) AS BIGINT) * (pos + 1)) % 101) / 100.0 AS combined_score
  FROM customer, LATERAL (VALUES (1, 'vendor_name', c_name, 'name'), (2, 'invoice_number', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 'id_number' ELSE 'text' END),
    (3, 'iban', CASE WHEN c_custkey % 3 = 0 THEN 'DE' || c_custkey END, 'text'), (4, 'tax_id', CASE WHEN c_custkey % 4 = 0 THEN 'T' || c_custkey END, 'text'), (5, 'segment', c_mktsegment, 'text')) f(pos, name, value, field_type))
  WHERE value IS NOT NULL)
"""


def corrections_of(spark, d):
    """Events as corrections: the type of event is the type of document, the user the document."""
    e = table(spark, d, "events")
    names = F.array(*[F.lit(n) for n in ("vendor_name", "iban", "segment", "unknown_field")])
    return e.select(
        F.col("user_id").alias("document_id"), F.col("event_type").alias("doc_type"), F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("field_name"),
        F.concat(F.lit("old "), F.col("event_id").cast("string")).alias("original_value"), F.concat(F.lit("new "), F.col("event_id").cast("string")).alias("corrected_value"),
        F.lit("Reviewer").alias("corrected_by"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("corrected_at"), F.col("props").alias("ocr_context_snippet"), F.col("event_id").alias("seq"),
    )


CORRECTIONS_SQL = """
corrections AS (SELECT user_id AS document_id, event_type AS doc_type, (['vendor_name', 'iban', 'segment', 'unknown_field'])[CAST(event_id % 4 AS INT) + 1] AS field_name, 'old ' || event_id AS original_value, 'new ' || event_id AS corrected_value,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS corrected_at, props AS snip, event_id AS seq FROM events)
"""


@register("confidentiality", f"""WITH {FIELDS_SQL},
p AS (SELECT document_id, doc_type, coalesce(array_to_string(list(name ORDER BY pos) FILTER (WHERE field_type = 'id_number' OR {' OR '.join(f"contains(lower(name), '{w}')" for w in K.PERSONAL_NAMES)}), ','), '') AS names,
  count(*) FILTER (WHERE field_type = 'id_number' OR {' OR '.join(f"contains(lower(name), '{w}')" for w in K.PERSONAL_NAMES)}) AS n FROM fields GROUP BY 1, 2)
SELECT document_id, doc_type, n >= 2 OR doc_type NOT IN ('invoice', 'other') AS is_confidential,
  CASE WHEN NOT (n >= 2 OR doc_type NOT IN ('invoice', 'other')) THEN 'none' WHEN doc_type NOT IN ('invoice', 'other') OR n >= 3 THEN 'high' ELSE 'low' END AS sensitivity_level, names AS masked_field_names FROM p""")
def confidentiality(spark, d):
    return privacy.classify(fields_of(spark, d)).select("document_id", "doc_type", "is_confidential", "sensitivity_level", F.array_join("masked_field_names", ",").alias("masked_field_names"))


@register("masked_view", f"""WITH {FIELDS_SQL}
SELECT document_id, name, h AS is_masked, CASE WHEN NOT h THEN value WHEN field_type = 'id_number' THEN 'XXXX-XXXX-' || right(value, 4) WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE left(value, 1) || repeat('*', length(value) - 2) || right(value, 1) END AS shown
FROM (SELECT *, document_id % 10 <> 0 AND (field_type = 'id_number' OR name IN ('iban', 'tax_id')) AS h FROM fields)""")
def masked_view(spark, d):
    f = fields_of(spark, d)
    opened = f.filter("document_id % 10 = 0").select("document_id")
    return privacy.masked_fields(f, opened).select("document_id", "name", "is_masked", "shown")


@register("overall_status", f"""WITH {FIELDS_SQL},
r AS (SELECT document_id, bool_or(bucket = 'red') AS red FROM fields GROUP BY 1)
SELECT document_id, CASE WHEN document_id % 9 = 0 THEN 'rejected' WHEN red OR document_id % 4 = 1 OR document_id % 7 = 2 THEN 'needs_review' ELSE 'auto_accepted' END AS overall_status FROM r""")
def overall_status(spark, d):
    f = fields_of(spark, d)
    docs = f.select("document_id").distinct().withColumn("quality_status", F.when(F.col("document_id") % 9 == 0, "rejected_too_degraded").otherwise("ok"))
    tests = docs.select("document_id", F.when(F.col("document_id") % 3 != 0, F.col("document_id") % 4 != 1).otherwise(F.when(F.col("document_id") % 4 == 1, False)).alias("passed"))
    flags = docs.filter("document_id % 2 = 0 or document_id % 7 = 2").select("document_id", F.when(F.col("document_id") % 7 == 2, "HIGH").otherwise("low").alias("severity"))
    return review.review_status(docs, f, tests, flags)


@register("corrections_overlay", f"""WITH {FIELDS_SQL}, {CORRECTIONS_SQL},
l AS (SELECT document_id, field_name, arg_max(corrected_value, seq) AS v FROM corrections GROUP BY 1, 2)
SELECT f.document_id, name, coalesce(v, value) AS value, CASE WHEN v IS NOT NULL THEN 1.0 ELSE combined_score END AS combined_score, CASE WHEN v IS NOT NULL THEN 'green' ELSE bucket END AS bucket, v IS NOT NULL AS manually_corrected
FROM fields f LEFT JOIN l ON l.document_id = f.document_id AND l.field_name = f.name""")
def corrections_overlay(spark, d):
    f = fields_of(spark, d).drop("manually_corrected")
    return review.overlay(f, corrections_of(spark, d)).select("document_id", "name", "value", "combined_score", "bucket", "manually_corrected")


@register("field_priority_sort", f"""WITH {FIELDS_SQL}
SELECT document_id, name, CASE bucket WHEN 'red' THEN 0 WHEN 'amber' THEN 1 ELSE 2 END AS priority, row_number() OVER (PARTITION BY document_id ORDER BY CASE bucket WHEN 'red' THEN 0 WHEN 'amber' THEN 1 ELSE 2 END, combined_score, pos) AS review_rank FROM fields""")
def field_priority_sort(spark, d):
    return review.review_rank(fields_of(spark, d)).select("document_id", "name", "priority", "review_rank")


@register("accuracy_stats", f"""WITH {FIELDS_SQL}
SELECT document_id, count(*) FILTER (WHERE bucket = 'green') AS n_green, count(*) AS n_fields, CAST(floor(count(*) FILTER (WHERE bucket = 'green') * 100 / greatest(count(*), 1)) AS INTEGER) AS accuracy_pct FROM fields GROUP BY 1""")
def accuracy_stats(spark, d):
    return review.accuracy(fields_of(spark, d))


@register("correction_counts", """
SELECT (SELECT count(*) FROM events WHERE event_type = (SELECT min(event_type) FROM events)) AS n_documents, (SELECT count(*) FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND event_id % 4 = 0) AS n_corrections
""")
def correction_counts(spark, d):
    c = corrections_of(spark, d)
    kind = c.agg(F.min("doc_type")).first()[0]
    return review.stats(c.select("doc_type"), c.filter("seq % 4 = 0"), kind)


@register("correction_trend", f"WITH {CORRECTIONS_SQL} SELECT left(corrected_at, 10) AS day, count(*) AS n FROM corrections GROUP BY 1")
def correction_trend(spark, d):
    return review.daily_trend(corrections_of(spark, d))


@register("topk_corrections", f"""WITH {CORRECTIONS_SQL}
SELECT doc_type, field_name, corrected_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_type, field_name ORDER BY seq DESC) AS rank FROM corrections) WHERE rank <= 3""")
def topk_corrections(spark, d):
    return review.latest(corrections_of(spark, d), 3, "doc_type", "field_name").select("doc_type", "field_name", "corrected_value", "rank")


@register("fewshot_block", f"""WITH {CORRECTIONS_SQL},
s AS (SELECT *, trim(replace(coalesce(snip, ''), chr(10), ' ')) AS t, row_number() OVER (PARTITION BY doc_type ORDER BY seq DESC) AS r FROM corrections)
SELECT doc_type, string_agg('- near ''' || CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END || ''' the right ' || field_name || ' is ''' || corrected_value || ''', not ''' || original_value || '''', chr(10) ORDER BY r) AS examples FROM s WHERE r <= 5 GROUP BY 1""")
def fewshot_block(spark, d):
    return review.examples(corrections_of(spark, d))


@register("upsert_current", """
WITH v AS (SELECT user_id, event_id AS seq, event_type AS h, CASE WHEN event_id % 3 = 0 THEN props END AS j, CASE WHEN event_id % 5 = 0 THEN event_type END AS t FROM events)
SELECT user_id AS document_id, min(seq) AS seq, arg_max(h, seq) AS file_hash_sha256, arg_max(j, seq) FILTER (WHERE j IS NOT NULL) AS full_result_json, arg_max(t, seq) FILTER (WHERE t IS NOT NULL) AS doc_type FROM v GROUP BY 1
""")
def upsert_current(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("file_hash_sha256"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("full_result_json"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("doc_type"))
    return store.fold_versions(v, "document_id", ["file_hash_sha256"], ["full_result_json", "doc_type"])


def _log(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("action"), F.lit("system").alias("actor"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("detail"), F.col("event_id").alias("seq"))


@register("audit_trail", "SELECT user_id AS document_id, event_type AS action, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN event_id % 2 = 0 THEN coalesce(props, '') ELSE '' END AS detail, event_id AS seq FROM events")
def audit_trail(spark, d):
    return review.audit_trail(_log(spark, d)).select("document_id", "action", "timestamp", "detail", "seq")


@register("audit_once", """
WITH a AS (SELECT min(event_type) AS a FROM events), old AS (SELECT DISTINCT user_id FROM events, a WHERE event_type = a AND event_id % 50 = 0)
SELECT user_id AS document_id, a AS action, min(event_id) AS seq FROM events, a WHERE event_type = a AND event_id % 50 <> 0 AND user_id NOT IN (SELECT user_id FROM old) GROUP BY 1, 2
""")
def audit_once(spark, d):
    log = _log(spark, d)
    action = log.agg(F.min("action")).first()[0]
    return review.audit_once(log.filter("seq % 50 != 0"), log.filter("seq % 50 = 0"), action).select("document_id", "action", "seq")


@register("chat_history_last4", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, string_agg(upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || trim(text), chr(10) ORDER BY turn) AS history FROM t WHERE r <= 4 GROUP BY 1
""")
def chat_history_last4(spark, d):
    return retrieval.recent_turns(table(spark, d, "conversations"))


@register("answer_refs", """
WITH doc AS (SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS id FROM documents),
a AS (SELECT doc_id AS answer_id, id, substr(sha256(CAST((doc_id + 1) % (SELECT count(*) FROM documents) AS VARCHAR)), 1, 16) AS other FROM doc)
SELECT answer_id, 'See ' || id || ' for this.' AS answer, CASE WHEN answer_id % 2 = 0 THEN other || ',' || id ELSE id END AS refs FROM a
""")
def answer_refs(spark, d):
    """Each answer names its document; every second one lists another in its tag."""
    docs = table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16).alias("document_id"))
    n = docs.count()
    other = F.substring(F.sha2(((F.col("doc_id") + 1) % n).cast("string"), 256), 1, 16)
    raw = F.concat(F.lit("See "), "document_id", F.lit(" for this.\nreferenced_docs: ["), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"'), other, F.lit('"'))).otherwise(""), F.lit("]"))
    answers = docs.select(F.col("doc_id").alias("answer_id"), raw.alias("raw"))
    out = retrieval.references(answers, docs.select("document_id", F.col("doc_id").alias("seq")))
    return out.select("answer_id", "answer", F.array_join("referenced_documents", ",").alias("refs"))


@register("context_lines", f"""WITH {FIELDS_SQL}
SELECT document_id, string_agg(name || ' = ' || CASE WHEN field_type = 'id_number' OR name IN ('iban', 'tax_id') THEN '[masked — verification required]' ELSE value END || ' [' || bucket || ' ' || printf('%.2f', combined_score) || ']', chr(10) ORDER BY pos) AS lines FROM fields GROUP BY 1""")
def context_lines(spark, d):
    f = privacy.masked_fields(fields_of(spark, d))
    return retrieval.field_lines(f)


@register("document_context", f"""WITH {FIELDS_SQL},
l AS (SELECT document_id, doc_type, string_agg(name || ' = ' || CASE WHEN field_type = 'id_number' OR name IN ('iban', 'tax_id') THEN '[masked — verification required]' ELSE value END || ' [' || bucket || ' ' || printf('%.2f', combined_score) || ']', chr(10) ORDER BY pos) AS lines FROM fields GROUP BY 1, 2),
r AS (SELECT document_id AS rid, string_agg('  ' || i || ') amount = ' || document_id || '; note = n' || i, chr(10) ORDER BY i) AS t FROM l, range(1, 11) x(i) WHERE i <= document_id % 14 GROUP BY 1)
SELECT document_id, '== ' || doc_type || '_' || left(document_id, 8) || ' (' || doc_type || '), of 2024-01-01, id ' || document_id || chr(10) || lines || chr(10)
  || CASE WHEN document_id % 14 > 0 THEN 'table items, rows: ' || document_id % 14 || chr(10) || t || chr(10) ELSE '' END
  || CASE WHEN document_id % 3 = 0 THEN 'checks: these fail: sum' ELSE 'checks: all hold' END || chr(10) || 'signs of tampering: ' || CASE WHEN document_id % 4 = 0 THEN '1' ELSE '0' END || chr(10)
  || CASE WHEN document_id % 2 = 0 THEN 'secrecy: high, because reason' ELSE 'secrecy: none' END || chr(10) || 'review: needs_review, corrections: 2' AS context
FROM l LEFT JOIN r ON rid = document_id""".replace("left(document_id, 8)", "left(CAST(document_id AS VARCHAR), 8)"))
def document_context(spark, d):
    f = privacy.masked_fields(fields_of(spark, d)).withColumn("document_id", F.col("document_id").cast("string"))
    key = F.col("document_id").cast("long")
    docs = f.select("document_id", "doc_type").distinct().select(
        "*", F.lit("").alias("filename"), F.lit("2024-01-01T00:00:00").alias("upload_timestamp"), (key % 2 == 0).alias("is_confidential"), F.lit("high").alias("sensitivity_level"),
        F.lit("reason").alias("reason"), F.lit("needs_review").alias("overall_status"), F.lit(2).alias("n_corrections"),
    )
    # Up to 13 rows, of which the first ten are shown.
    rows = docs.select("document_id", F.explode(F.when(key % 14 > 0, F.sequence(F.lit(1), (key % 14).cast("int")))).alias("row_index"))
    cell = lambda pos, name, value: F.struct(F.lit(pos).alias("col_pos"), F.lit(name).alias("col_name"), value.alias("value"))
    columns = F.explode(F.array(cell(0, "amount", F.col("document_id")), cell(1, "note", F.concat(F.lit("n"), F.col("row_index").cast("string")))))
    cells = rows.select("document_id", F.lit(0).alias("table_idx"), F.lit("items").alias("table_name"), "row_index", columns.alias("c")).select("document_id", "table_idx", "table_name", "row_index", "c.*")
    checks = docs.select("document_id", F.lit("sum").alias("check_name"), (key % 3 != 0).alias("passed"))
    flags = docs.filter(key % 4 == 0).select("document_id")
    return retrieval.context(docs, f, cells, checks, flags).withColumn("document_id", F.col("document_id").cast("long"))


@register("json_answers", """
SELECT event_id AS document_id, name, value, field_type FROM (SELECT event_id, unnest(['total_amount', 'vendor_name', 'note']) AS name, unnest([CAST(event_id AS VARCHAR) || '.5', 'ACME ' || event_type, CASE WHEN event_id % 2 = 0 THEN 'ok' END]) AS value, unnest(['amount', 'name', 'text']) AS field_type FROM events WHERE event_id % 7 <> 0) WHERE value IS NOT NULL
""")
def json_answers(spark, d):
    """Model answers with fences, talk around them, fields as a JSON text, or no JSON at all."""
    e, k = table(spark, d, "events"), F.col("event_id")
    body = F.concat(F.lit('{"total_amount": '), k.cast("string"), F.lit('.5, "vendor_name": "ACME '), F.col("event_type"), F.lit('", "note": '), F.when(k % 2 == 0, '"ok"').otherwise("null"), F.lit("}"))
    quoted = F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('\\"')), F.lit('"'))
    whole = F.concat(F.lit('{"fields": '), F.when(k % 5 == 0, quoted).otherwise(body), F.lit(', "tables": []}'))
    raw = F.when(k % 7 == 0, "no answer").when(k % 3 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("Here it is: "), whole, F.lit(" Done."))).otherwise(whole)
    answers = e.select(k.alias("document_id"), F.lit("invoice").alias("doc_type"), extraction.parse_answer(raw).alias("answer"))
    return extraction.fields_of(answers).select("document_id", "name", "value", "field_type")


@register("json_cells", """
SELECT event_id AS document_id, 0 AS table_idx, CASE WHEN event_id % 2 = 0 THEN 'line_items' ELSE 'table_1' END AS table_name, r AS row_index, col AS col_name, CASE col WHEN 'description' THEN event_type ELSE CAST(r AS VARCHAR) END AS value
FROM events, (VALUES (1), (2)) rows_(r), (VALUES ('description'), ('amount')) cols(col)
""")
def json_cells(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    row = lambda i: F.concat(F.lit('{"description": "'), F.col("event_type"), F.lit(f'", "amount": "{i}", "empty": null}}'))
    raw = F.concat(F.lit('{"fields": {}, "tables": [{'), F.when(k % 2 == 0, '"table_name": "line_items", ').otherwise(""), F.lit('"rows": ['), row(1), F.lit(", "), row(2), F.lit("]}]}"))
    answers = e.select(k.alias("document_id"), extraction.parse_answer(raw).alias("answer"))
    return extraction.cells_of(answers).select("document_id", "table_idx", "table_name", "row_index", "col_name", "value")


@register("extraction_prompts", """
SELECT doc_id, length(text) AS n_text, true AS has_text, doc_id % 5 <> 4 AS has_schema, doc_id % 2 = 0 AS has_memory FROM documents
""")
def extraction_prompts(spark, d):
    """Prompts for every document, whole texts, every second with earlier corrections."""
    docs = table(spark, d, "documents")
    kind = F.element_at(F.array(*[F.lit(t) for t in K.DOC_TYPES]), (F.col("doc_id") % 5 + 1).cast("int"))
    prompt = extraction.extraction_prompt(kind, F.col("text"), F.when(F.col("doc_id") % 2 == 0, "- near 'x' the right y is 'z'"))
    field = F.element_at(F.create_map(*[F.lit(x) for t, s in K.SCHEMAS.items() for x in (t, next(iter(s["fields"]), "no such field"))]), kind)
    return docs.select("doc_id", F.length("text").cast("long").alias("n_text"), F.endswith(prompt, F.col("text")).alias("has_text"), F.contains(prompt, F.concat(F.lit("Fields: "), field)).alias("has_schema"), F.contains(prompt, F.lit("Earlier corrections:")).alias("has_memory"))


def _wanted_sql() -> str:
    """What the prompt of each type of document asks for, as SQL: its fields and tables, as they are fixed."""
    each = []
    for i, kind in enumerate(K.DOC_TYPES):
        fields = ", ".join(K.SCHEMAS[kind]["fields"]) or "every labelled value, with short lower-case names"
        tables = "; ".join(f"{t} ({', '.join(c)})" for t, c in K.SCHEMAS[kind]["tables"].items()) or "those that the document has"
        each.append(f"WHEN {i} THEN 'Document type: {kind}' || chr(10) || 'Fields: {fields}' || chr(10) || 'Tables: {tables}' || chr(10)")
    return "CASE doc_id % 5 " + " ".join(each) + " END"


@register("prompts", f"""
WITH d AS (SELECT doc_id, text, lang, left(text, 4000) AS head, ([{", ".join(f"'{t}'" for t in K.DOC_TYPES)}])[CAST(doc_id % 5 AS INT) + 1] AS kind, {_wanted_sql()} AS wanted FROM documents)
SELECT doc_id, sha256('Name the type of this document with one of: invoice, payslip, id_proof, bank_statement, other.' || chr(10) || chr(10) || head) AS classification,
  sha256(wanted || CASE WHEN doc_id % 2 = 0 THEN 'Earlier corrections:' || chr(10) || '- near this use that' || chr(10) ELSE '' END
    || 'Give one JSON object {{"fields": {{name: value}}, "tables": [{{"table_name": name, "rows": [{{column: value}}]}}]}} and nothing else. A value that the text does not have is null.' || chr(10) || chr(10) || text) AS extraction,
  sha256('Document type: ' || kind || chr(10) || 'For each field give how surely the text has its value, from 0 to 1, as one JSON object.' || chr(10) || 'number: ' || doc_id || chr(10) || 'language: ' || CASE WHEN doc_id % 3 > 0 THEN lang ELSE 'null' END || chr(10) || chr(10) || head) AS rating FROM d
""")
def prompts(spark, d):
    """The three prompts of every document, as digests: whole texts to extract from, the first 4,000 characters to classify and to rate."""
    docs = table(spark, d, "documents")
    kind = F.element_at(F.array(*[F.lit(t) for t in K.DOC_TYPES]), (F.col("doc_id") % 5 + 1).cast("int"))
    rated = F.array(F.struct(F.lit("number").alias("name"), F.col("doc_id").cast("string").alias("value")), F.struct(F.lit("language").alias("name"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("value")))
    made = {
        "classification": extraction.classification_prompt(F.col("text")),
        "extraction": extraction.extraction_prompt(kind, F.col("text"), F.when(F.col("doc_id") % 2 == 0, "- near this use that")),
        "rating": extraction.rating_prompt(kind, rated, F.col("text")),
    }
    return docs.select("doc_id", *[F.sha2(x, 256).alias(n) for n, x in made.items()])


@register("export_records", f"""WITH {FIELDS_SQL}
SELECT document_id, '[' || string_agg('{{"name":"' || name || '","value":"' || CASE WHEN NOT h THEN value WHEN field_type = 'id_number' THEN 'XXXX-XXXX-' || right(value, 4) WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE left(value, 1) || repeat('*', length(value) - 2) || right(value, 1) END || '","bucket":"' || bucket || '"}}', ',' ORDER BY pos) || ']' AS record
FROM (SELECT *, field_type = 'id_number' OR name IN ('iban', 'tax_id') AS h FROM fields) GROUP BY 1""")
def export_records(spark, d):
    """Fields of every document as JSON, personal values masked."""
    return display.exported(privacy.masked_fields(fields_of(spark, d)), masked=True)


@register("field_frame", f"""WITH {FIELDS_SQL}
SELECT document_id, pos, CASE name WHEN 'vendor_name' THEN 'Vendor Name' WHEN 'invoice_number' THEN 'Invoice Number' WHEN 'iban' THEN 'Iban' WHEN 'tax_id' THEN 'Tax Id' ELSE 'Segment' END AS field, CASE WHEN NOT h THEN value WHEN field_type = 'id_number' THEN 'XXXX-XXXX-' || right(value, 4) WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE left(value, 1) || repeat('*', length(value) - 2) || right(value, 1) END AS value,
  bucket AS confidence, combined_score, h AS is_masked FROM (SELECT *, field_type = 'id_number' OR name IN ('iban', 'tax_id') AS h FROM fields)""")
def field_frame(spark, d):
    return display.field_frame(privacy.masked_fields(fields_of(spark, d)))


@register("table_frame", """
SELECT l_orderkey AS document_id, 0 AS table_idx, 'line_items' AS table_name, r AS row_index, 'Line No2A: ' || l_linenumber || ' | Part Key: ' || CASE WHEN l_partkey % 5 > 0 THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS cells
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)
""")
def table_frame(spark, d):
    """Lines of orders as rows of a table of two columns, one of which may be empty."""
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    cell = lambda pos, name, value: F.struct(F.lit(pos).alias("col_pos"), F.lit(name).alias("col_name"), value.cast("string").alias("value"))
    cells = F.array(cell(1, "part_key", F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey"))), cell(0, "line_no2a", F.col("l_linenumber")))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(0).alias("table_idx"), F.lit("line_items").alias("table_name"), row.alias("row_index"), cells.alias("cells"))
    return display.table_frame(rows.select("document_id", "table_idx", "table_name", "row_index", F.explode("cells").alias("c")).select("document_id", "table_idx", "table_name", "row_index", "c.*"))


@register("record_files", """
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'order.' || o_orderkey END || '_extracted_record.json' AS file_name,
  '{"document_id":"' || o_orderkey || '","doc_type":' || CASE WHEN o_orderkey % 2 = 0 THEN '"invoice"' ELSE 'null' END || ',"extracted_fields":[{"name":"status","value":"' || o_orderstatus || '"},{"name":"key","value":"' || o_orderkey || '"}]}' AS record FROM orders
""")
def record_files(spark, d):
    """Orders as stored records: their whole JSON, without the white space that is there for people, and the names of their files."""
    k = F.col("o_orderkey").cast("string")
    fields = F.array(F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("key").alias("name"), k.alias("value")))
    result = F.struct(k.alias("document_id"), F.when(F.col("o_orderkey") % 2 == 0, "invoice").alias("doc_type"), fields.alias("extracted_fields"))
    name = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("order."), k, F.lit(".pdf")))
    made = display.records(table(spark, d, "orders").select(k.alias("document_id"), name.alias("original_filename"), result.alias("r")))
    return made.withColumn("record", F.regexp_replace("record", r"\n *|(?<=[:,\[]) | (?=[:\]}])", ""))



@register("reveal_attempts", """
SELECT user_id AS document_id, event_id AS seq, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'confidential_field_revealed' ELSE 'confidential_reveal_failed' END AS action, CASE event_id % 3 WHEN 0 THEN ' Admin' WHEN 1 THEN 'guest' ELSE 'reviewer' END AS actor FROM events
""")
def reveal_attempts(spark, d):
    """Attempts of three roles, of which one has a pin that is right every second time."""
    k = F.col("event_id")
    tries = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.when(k % 3 == 0, " Admin").when(k % 3 == 1, "guest").otherwise("reviewer").alias("role"), F.when(k % 2 == 0, " s1").otherwise("s2").alias("entered"), F.col("ts").cast("string").alias("timestamp"), k.alias("seq"))
    pins = spark.createDataFrame([("admin", "s1"), ("Reviewer", "s3")], "role string, pin string")
    return review.reveal_attempts(tries, pins).select("document_id", "seq", "action", "actor")


@register("reference_names", """
SELECT event_id AS answer_id, CAST(user_id AS VARCHAR) || '-document' AS document_id, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) || '.pdf' ELSE left(CAST(user_id AS VARCHAR) || '-document', 8) END AS shown FROM events
""")
def reference_names(spark, d):
    e = table(spark, d, "events").withColumn("document_id", F.concat(F.col("user_id").cast("string"), F.lit("-document")))
    held = e.filter("user_id % 2 = 0").select("document_id", F.concat(F.col("user_id").cast("string"), F.lit(".pdf")).alias("original_filename"), F.col("event_id").alias("seq"))
    return display.reference_names(e.select(F.col("event_id").alias("answer_id"), "document_id"), held)


APPLIED_SQL = """
lines AS (SELECT l_orderkey AS document_id, (['status', 'priority', 'total', 'other'])[CAST(l_linenumber % 4 AS INT) + 1] AS field_name, trim(' v' || l_partkey || ' ') AS v,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem WHERE l_orderkey % 2 = 0),
last AS (SELECT document_id, field_name, arg_max(v, seq) AS v FROM lines GROUP BY 1, 2),
f AS (SELECT o_orderkey AS document_id, name, value, score, CASE WHEN score >= 0.75 THEN 'green' WHEN score >= 0.4 THEN 'amber' ELSE 'red' END AS bucket, o_orderkey % 11 = 0 AS failed, o_orderkey % 13 = 0 AS high
  FROM orders, LATERAL (VALUES ('status', o_orderstatus, 0.9), ('priority', o_orderpriority, (o_orderkey % 10) / 10.0), ('total', CAST(o_orderkey AS VARCHAR), 0.5)) t(name, value, score)),
g AS (SELECT f.document_id, name, coalesce(v, value) AS value, CASE WHEN v IS NULL THEN score ELSE 1.0 END AS combined_score, CASE WHEN v IS NULL THEN bucket ELSE 'green' END AS bucket, failed, high FROM f LEFT JOIN last ON last.document_id = f.document_id AND field_name = name
  WHERE f.document_id IN (SELECT document_id FROM last))
"""


@register("applied_corrections", f"""WITH {APPLIED_SQL},
s AS (SELECT document_id, CASE WHEN bool_or(bucket = 'red') OR any_value(failed) OR any_value(high) THEN 'needs_review' ELSE 'auto_accepted' END AS overall_status FROM g GROUP BY 1)
SELECT document_id, name, value, combined_score, bucket, overall_status FROM g JOIN s USING (document_id)""")
def applied_corrections(spark, d):
    """Orders as stored results of three fields, lines of every second order as corrections: the last of each field is its value, and the
    status is judged anew."""
    key = F.col("o_orderkey")
    part = lambda n, v, s: F.struct(F.lit(n).alias("name"), v.alias("value"), F.struct(s.alias("combined_score"), bucket(s).alias("bucket")).alias("confidence"))
    fields = F.array(part("status", F.col("o_orderstatus"), F.lit(0.9)), part("priority", F.col("o_orderpriority"), (key % 10) / 10.0), part("total", key.cast("string"), F.lit(0.5)))
    result = F.struct(fields.alias("extracted_fields"), F.array(F.struct((key % 11 != 0).alias("passed"))).alias("cross_checks"), F.array(F.struct(F.when(key % 13 == 0, "High").otherwise("low").alias("severity"))).alias("tamper_flags"), F.lit("").alias("overall_status"))
    results = table(spark, d, "orders").select(key.alias("document_id"), result.alias("r"))
    names = F.array(*[F.lit(n) for n in ("status", "priority", "total", "other")])
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    made = table(spark, d, "lineitem").filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("document_id"), F.element_at(names, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("field_name"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("corrected_value"), order.alias("seq"))
    done = store.applied_corrections(results, made)
    return done.select("document_id", F.explode("result.extracted_fields").alias("f"), F.col("result.overall_status").alias("overall_status")).select("document_id", "f.name", "f.value", "f.confidence.combined_score", "f.confidence.bucket", "overall_status")


@register("session_corrections", """
SELECT user_id AS document_id, (['vendor_name', 'iban', 'segment', 'unknown_field'])[CAST(event_id % 4 AS INT) + 1] AS field_name, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'old ' || event_id END AS original_value,
  'new ' || event_id AS corrected_value, CASE event_id % 4 WHEN 0 THEN 'Ann' ELSE 'Reviewer' END AS corrected_by, strftime(ts, '%Y-%m-%d %H:%M:%S') AS corrected_at, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events
""")
def session_corrections(spark, d):
    """Corrections of every document as they are shown, with the place of each among those of its document."""
    made = corrections_of(spark, d).withColumn("original_value", F.when(F.col("seq") % 3 != 0, F.col("original_value"))).withColumn("corrected_by", F.when(F.col("seq") % 4 == 0, "Ann").when(F.col("seq") % 4 == 1, ""))
    return store.session_corrections(made).withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("seq")))


@register("field_ratings", f"""WITH {FIELDS_SQL},
r AS (SELECT document_id, name, (['0.35', '1.7', '-0.2', 'sure', '1e-1', '', ' 0.5 '])[CAST((document_id + pos) % 7 AS INT) + 1] AS rating FROM fields WHERE (document_id + pos) % 8 <> 0)
SELECT f.document_id, f.name, CASE WHEN TRY_CAST(trim(rating) AS DOUBLE) IS NOT NULL THEN greatest(0.0, least(1.0, TRY_CAST(trim(rating) AS DOUBLE))) END AS llm_confidence FROM fields f LEFT JOIN r ON r.document_id = f.document_id AND r.name = f.name
""")
def field_ratings(spark, d):
    """What a model says of its fields, joined to them: numbers cut to 0 and 1, other answers and fields that it leaves out are null."""
    fields = fields_of(spark, d)
    place = F.col("document_id") + F.col("pos")
    said = F.element_at(F.array(*[F.lit(t) for t in ("0.35", "1.7", "-0.2", "sure", "1e-1", "", " 0.5 ")]), (place % 7 + 1).cast("int"))
    raw = fields.filter(place % 8 != 0).select("document_id", "name", said.alias("rating"))
    return fields.select("document_id", "name").join(scoring.ratings(raw), ["document_id", "name"], "left")
