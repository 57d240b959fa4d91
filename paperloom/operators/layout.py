"""From recognised words to lines, page texts, document texts and recognition metrics.

words: document_id, page, word_idx, text, confidence, x, y, width, height, block_num, par_num, line_num.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.functions.values import mean4, units


def without_noise(words: DataFrame) -> DataFrame:
    """Words with text and a confidence that is not negative."""
    return words.filter((F.trim("text") != "") & (F.col("confidence") >= 0))


def words_to_lines(words: DataFrame, dealt: bool = False) -> DataFrame:
    """Words with one key are a line, read from left to right; lines go in the order of their first words. Words
    without a key are grouped by height on the page. Dealt once, by page; not at all if they are dealt by document or page already."""
    keyed = (words if dealt else words.repartition("document_id", "page")).select(
        "*",
        F.coalesce("block_num", F.lit(0)).alias("b"),
        F.coalesce("par_num", F.lit(0)).alias("p"),
        F.coalesce("line_num", F.floor(F.col("y") / K.LINE_BUCKET).cast("int")).alias("l"),
    )
    left_to_right = F.array_sort(F.collect_list(F.struct("x", "word_idx", "text")))
    lines = keyed.groupBy("document_id", "page", "b", "p", "l").agg(
        F.min("word_idx").alias("first_word"),
        F.array_join(F.transform(left_to_right, lambda w: w["text"]), " ").alias("text"),
        mean4(F.sum(units(F.col("confidence"))), F.count(F.lit(1))).alias("confidence"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
    )
    order = Window.partitionBy("document_id", "page").orderBy("first_word")
    return lines.select("document_id", "page", (F.row_number().over(order) - 1).alias("line_idx"), "text", "confidence", "x", "y", "width", "height")


def _joined(column: str, order: str, separator: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(column)))), lambda s: s[column]), separator)


def page_texts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("document_id", "page").agg(_joined("text", "line_idx", "\n").alias("full_text"))


def document_texts(pages: DataFrame) -> DataFrame:
    marked = pages.withColumn("marked", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("full_text")))
    return marked.groupBy("document_id").agg(_joined("marked", "page", "\n\n").alias("document_text"))


def metrics(words: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Mean word confidence and the number of words below the limit; both 0 for documents (document_id) without words."""
    low = F.count_if(F.col("confidence") < K.LOW_WORD_CONFIDENCE)
    found = words.groupBy("document_id").agg(mean4(F.sum(units(F.col("confidence"))), F.count(F.lit(1))).alias("average_confidence"), low.alias("low_confidence_word_count"))
    return found if documents is None else documents.select("document_id").distinct().join(found, "document_id", "left").fillna({"average_confidence": 0.0, "low_confidence_word_count": 0})
