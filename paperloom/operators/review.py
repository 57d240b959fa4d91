"""Reviewers' corrections, status of documents, audit events and metrics.

corrections: document_id, doc_type, field_name, original_value, corrected_value, corrected_by, corrected_at,
ocr_context_snippet and seq, the order in which they were made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scores import overall_status
from paperloom.functions.text import snippet


def overlay(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """fields (document_id, name, value, combined_score, bucket) with the last correction of each applied; fields
    that do not exist are not added."""
    last = corrections.groupBy("document_id", F.col("field_name").alias("name")).agg(F.max_by(F.coalesce("corrected_value", F.lit("")), "seq").alias("corrected"))
    done = F.col("corrected").isNotNull()
    out = fields.join(last, ["document_id", "name"], "left")
    return out.select(
        *[c for c in fields.columns if c not in ("value", "combined_score", "bucket")],
        F.coalesce("corrected", "value").alias("value"),
        F.when(done, 1.0).otherwise(F.col("combined_score")).alias("combined_score"),
        F.when(done, "green").otherwise(F.col("bucket")).alias("bucket"),
        done.alias("manually_corrected"),
    )


def review_status(documents: DataFrame, fields: DataFrame, checks: DataFrame, flags: DataFrame) -> DataFrame:
    """(document_id, overall_status) of documents (document_id, quality_status)."""
    red = fields.groupBy("document_id").agg(F.bool_or(F.col("bucket") == "red").alias("red"))
    failed = checks.groupBy("document_id").agg(F.bool_or(~F.coalesce("passed", F.lit(True))).alias("failed"))
    high = flags.groupBy("document_id").agg(F.bool_or(F.lower("severity") == "high").alias("high"))
    out = documents
    for part in (red, failed, high):
        out = out.join(part, "document_id", "left")
    return out.select("document_id", overall_status(F.col("quality_status"), F.col("red"), F.col("failed"), F.col("high")).alias("overall_status"))


def by_priority(fields: DataFrame) -> DataFrame:
    """Fields in the order of review: red, amber, the rest; then by score; corrected ones as the rest."""
    rank = F.when(F.col("manually_corrected"), 2).when(F.col("bucket") == "red", 0).when(F.col("bucket") == "amber", 1).otherwise(2)
    return fields.withColumn("priority", rank).orderBy("priority", "combined_score", "document_id", "pos")


def review_rank(fields: DataFrame) -> DataFrame:
    """As by_priority, as a rank within each document."""
    rank = F.when(F.col("manually_corrected"), 2).when(F.col("bucket") == "red", 0).when(F.col("bucket") == "amber", 1).otherwise(2)
    order = Window.partitionBy("document_id").orderBy("priority", "combined_score", "pos")
    return fields.withColumn("priority", rank).withColumn("review_rank", F.row_number().over(order))


def accuracy(fields: DataFrame) -> DataFrame:
    """Whole percentage of green fields of each document, cut, not rounded."""
    green = F.count_if(F.col("bucket") == "green")
    return fields.groupBy("document_id").agg(green.alias("n_green"), F.count(F.lit(1)).alias("n_fields"), F.floor(green * 100 / F.greatest(F.count(F.lit(1)), F.lit(1))).cast("int").alias("accuracy_pct"))


def latest(corrections: DataFrame, k: int, *by: str) -> DataFrame:
    """The k corrections made last of each group, last first."""
    order = Window.partitionBy(*by).orderBy(F.desc("seq"))
    return corrections.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def examples(corrections: DataFrame, k: int = 5) -> DataFrame:
    """(doc_type, examples): guidance from the last k corrections of each type, one line each."""
    line = F.concat(
        F.lit("- near '"), snippet(F.col("ocr_context_snippet")), F.lit("' the right "), F.col("field_name"), F.lit(" is '"),
        F.coalesce("corrected_value", F.lit("")), F.lit("', not '"), F.coalesce("original_value", F.lit("")), F.lit("'"),
    )
    rows = latest(corrections, k, "doc_type").select("doc_type", "rank", line.alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"])
    return rows.groupBy("doc_type").agg(F.array_join(ordered, "\n").alias("examples"))


def stats(documents: DataFrame, corrections: DataFrame, doc_type: str | None = None) -> DataFrame:
    """One row: documents and corrections, of one type if given."""
    if doc_type:
        documents, corrections = (d.filter(F.col("doc_type") == doc_type) for d in (documents, corrections))
    return documents.agg(F.count(F.lit(1)).alias("n_documents")).join(corrections.agg(F.count(F.lit(1)).alias("n_corrections")), F.lit(True))


def daily_trend(corrections: DataFrame, doc_type: str | None = None) -> DataFrame:
    if doc_type:
        corrections = corrections.filter(F.col("doc_type") == doc_type)
    return corrections.groupBy(F.substring(F.col("corrected_at").cast("string"), 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day")


def audit_once(events: DataFrame, log: DataFrame, action: str) -> DataFrame:
    """Events of an action whose documents have none in the log yet, one a document."""
    there = log.filter(F.col("action") == action).select("document_id")
    fresh = events.filter(F.col("action") == action).join(there, "document_id", "left_anti")
    order = Window.partitionBy("document_id").orderBy("seq")
    return fresh.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def audit_trail(log: DataFrame, document_id=None) -> DataFrame:
    """Events in order; a missing detail is empty."""
    if document_id is not None:
        log = log.filter(F.col("document_id") == document_id)
    return log.withColumn("detail", F.coalesce("detail", F.lit(""))).orderBy("document_id", "seq")


def verify_pin(pins: dict[str, str], role: str | None, entered: object) -> bool:
    """pins by role, from configuration; never written in code."""
    expected = pins.get(str(role).strip().lower()) if role else None
    return expected is not None and entered is not None and str(entered).strip() == str(expected).strip()


def reveal_attempts(attempts: DataFrame, pins: DataFrame) -> DataFrame:
    """Audit events of attempts (document_id, role, entered, timestamp, seq) to see masked fields. pins (role, pin) come
    from configuration; an unknown role fails."""
    known = pins.select(F.lower(F.trim("role")).alias("role_key"), F.trim("pin").alias("pin"))
    tried = attempts.withColumn("role_key", F.lower(F.trim("role"))).join(known, "role_key", "left")
    ok = F.coalesce(F.trim("entered") == F.col("pin"), F.lit(False))
    action = F.when(ok, "confidential_field_revealed").otherwise("confidential_reveal_failed")
    return tried.select("document_id", action.alias("action"), F.coalesce("role", F.lit("")).alias("actor"), "timestamp", F.when(ok, "fields shown").otherwise("wrong pin").alias("detail"), "seq")


def revealed(log: DataFrame) -> DataFrame:
    """(document_id) of documents whose fields were shown after the last time that they were hidden."""
    last = log.filter(F.col("action").isin("confidential_field_revealed", "confidential_field_masked")).groupBy("document_id").agg(F.max_by("action", "seq").alias("action"))
    return last.filter("action = 'confidential_field_revealed'").select("document_id")
