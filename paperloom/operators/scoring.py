"""Confidence of fields, cells and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scores import cell_score, clamp_rating, combine
from paperloom.functions.values import mean4, rule_passed, units
from paperloom.operators.grounding import field_confidence


def ratings(raw: DataFrame) -> DataFrame:
    """raw (document_id, name, rating text) to (document_id, name, llm_confidence), numbers from 0 to 1 only."""
    return raw.select("document_id", "name", clamp_rating(F.col("rating")).alias("llm_confidence")).filter("llm_confidence is not null")


def score_fields(fields: DataFrame, words: DataFrame, llm: DataFrame) -> DataFrame:
    """fields (document_id, name, value, field_type, page, x, y, width, height) with a confidence STRUCT."""
    key = ["document_id", "name"]
    out = fields.join(field_confidence(fields, words), key).join(llm, key, "left")
    return out.withColumn("confidence", combine(F.col("ocr_confidence"), F.col("llm_confidence"), rule_passed(F.col("value"), F.col("field_type")))).drop("ocr_confidence", "llm_confidence")


def score_cells(cells: DataFrame) -> DataFrame:
    """cells (…, value, ocr_confidence or null) with confidence."""
    return cells.withColumn("confidence", cell_score(F.col("ocr_confidence"), F.col("value")))


def score_tables(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(document_id, table_idx, table_confidence) of scored cells; 0 for one of tables (document_id, table_idx) without."""
    found = cells.groupBy("document_id", "table_idx").agg(F.coalesce(mean4(F.sum(units(F.col("confidence"))), F.count("confidence")), F.lit(0.0)).alias("table_confidence"))
    return found if tables is None else tables.select("document_id", "table_idx").distinct().join(found, ["document_id", "table_idx"], "left").fillna(0.0, ["table_confidence"])


def table_boxes(cells: DataFrame) -> DataFrame:
    """Box around a table's placed cells; its page is that of the last of them."""
    placed = cells.filter("x is not null")
    return placed.groupBy("document_id", "table_idx").agg(
        F.max_by("page", F.struct("row_index", "col_pos")).alias("page"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
    )
