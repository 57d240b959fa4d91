"""Placing values on the page: interval joins of fields, lines and words.

fields and values: document_id, name and, for boxes, page, x, y, width, height.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from paperloom.functions import constants as K
from paperloom.functions.scores import overlap
from paperloom.functions.text import normalised, nullish, strip
from paperloom.functions.values import mean4, units

BOX = ("x", "y", "width", "height")


def field_confidence(fields: DataFrame, words: DataFrame) -> DataFrame:
    """(document_id, name, ocr_confidence): mean over the words that overlap the field's box on its page, else 0."""
    w = words.select("document_id", *[F.col(c).alias(f"w_{c}") for c in ("page", *BOX, "confidence")])
    inside = overlap(tuple(F.col(c) for c in BOX), tuple(F.col(f"w_{c}") for c in BOX))
    # Joined by document, as words are dealt: the page is compared like the box.
    hit = fields.filter("page is not null").join(w, "document_id").filter(F.col("w_page").between(F.col("page"), F.col("page")) & inside)
    mean = hit.groupBy("document_id", "name").agg(mean4(F.sum(units(F.col("w_confidence"))), F.count(F.lit(1))).alias("ocr_confidence"))
    return fields.select("document_id", "name").join(mean, ["document_id", "name"], "left").select("document_id", "name", F.coalesce("ocr_confidence", F.lit(0.0)).alias("ocr_confidence"))


def _values(values: DataFrame) -> DataFrame:
    v = values.filter(~nullish(F.col("value"))).select("document_id", "name", strip("value").alias("value"))
    return v.withColumn("norm", normalised(F.col("value"))).filter("norm != ''")


def by_line(values: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """The line that holds the value and has least besides; on ties the first. Its words that are part of the value
    give the box, or the line itself if there is none."""
    v = _values(values)
    ln = lines.select("document_id", "page", "line_idx", F.col("text").alias("line_text"), *[F.col(c).alias(f"l_{c}") for c in BOX])
    line_norm = normalised(F.col("line_text"))
    holds = F.contains(F.lower("line_text"), F.lower("value")) | F.contains(line_norm, F.col("norm"))
    score = 1.0 + F.length("norm") / F.greatest(F.length(line_norm), F.lit(1))
    found = v.join(ln, "document_id").filter(holds).withColumn("score", score)
    best = F.max_by(F.struct("page", "line_idx", "line_text", *[f"l_{c}" for c in BOX], "score", "value", "norm"), F.struct("score", -F.col("page"), -F.col("line_idx"))).alias("m")
    best = found.groupBy("document_id", "name").agg(best).select("document_id", "name", "m.*")
    w = words.select("document_id", "word_idx", F.col("text").alias("word"), *[F.col(c).alias(f"w_{c}") for c in ("page", *BOX)])
    # Joined by document, as words are dealt: the page is compared like the height.
    near = F.col("w_page").between(F.col("page"), F.col("page")) & F.contains(F.col("norm"), normalised(F.col("word"))) & F.col("w_y").between(F.col("l_y") - K.LINE_MARGIN, F.col("l_y") + F.col("l_height") + K.LINE_MARGIN)
    part = best.join(w, "document_id").filter(near).groupBy("document_id", "name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda s: s["word"]), " ").alias("raw"),
        F.min("w_x").alias("x"), F.min("w_y").alias("y"),
        (F.max(F.col("w_x") + F.col("w_width")) - F.min("w_x")).alias("width"),
        (F.max(F.col("w_y") + F.col("w_height")) - F.min("w_y")).alias("height"),
    )
    out = best.join(part, ["document_id", "name"], "left")
    return out.select("document_id", "name", F.lit("line").alias("method"), "score", F.coalesce("raw", "line_text").alias("raw_text"), "page", *[F.coalesce(c, f"l_{c}").alias(c) for c in BOX])


def by_word(values: DataFrame, words: DataFrame) -> DataFrame:
    """The first word equal to the value but for punctuation and case."""
    w = words.select("document_id", normalised(F.col("text")).alias("norm"), "page", "word_idx", "text", *BOX).filter("norm != ''")
    found = _values(values).join(w, ["document_id", "norm"])
    first = F.min_by(F.struct("text", "page", *BOX), F.struct("page", "word_idx")).alias("m")
    return found.groupBy("document_id", "name").agg(first).select("document_id", "name", F.lit("word").alias("method"), F.lit(1.0).alias("score"), F.col("m.text").alias("raw_text"), "m.page", *[f"m.{c}" for c in BOX])


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters, the value first: the order matters."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def may_be_similar(a: Column, b: Column, ratio: float = K.FUZZY_RATIO) -> Column:
    """Whether two texts can reach a ratio of matching characters, 2 m / (len(a) + len(b)): m is at most the shorter length, and at most
    what they share of each character. Both bounds are without error; the second is looked at only where the first leaves hope."""
    both = F.length(a) + F.length(b)
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    return F.when(2 * F.least(F.length(a), F.length(b)) < ratio * both, False).otherwise(2 * shared >= ratio * both)


def similar_candidates(values: DataFrame, lines: DataFrame) -> DataFrame:
    """Values with the lines of their documents that they can be similar to, by bounds that need no Python."""
    ln = lines.select("document_id", "page", "line_idx", F.col("text").alias("raw_text"), *BOX)
    return _values(values).join(ln, "document_id").filter(may_be_similar(F.lower("value"), F.lower("raw_text")))


def by_similarity(values: DataFrame, lines: DataFrame) -> DataFrame:
    """The most similar line of the first page that has one similar enough."""
    near = similar_candidates(values, lines).withColumn("score", similarity(F.lower("value"), F.lower("raw_text"))).filter(F.col("score") >= K.FUZZY_RATIO)
    order = Window.partitionBy("document_id", "name").orderBy("page", F.desc("score"), "line_idx")
    best = near.withColumn("rank", F.row_number().over(order)).filter("rank = 1")
    return best.select("document_id", "name", F.lit("similar").alias("method"), "score", "raw_text", "page", *BOX)


def ground(values: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """A place for each value that has one: by line, else by word, else by similarity; the dear tier sees only what
    the cheap ones left."""
    key = ["document_id", "name"]
    line = by_line(values, lines, words)
    rest = values.join(line, key, "left_anti")
    word = by_word(rest, words)
    return line.unionByName(word).unionByName(by_similarity(rest.join(word, key, "left_anti"), lines))
