"""What is shown or handed out: field and table frames, exports, overlays' colours, names of referenced documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scores import crop, word_colour
from paperloom.functions.text import label, mask_value
from paperloom.operators import pixels


def field_frame(fields: DataFrame) -> DataFrame:
    """fields (document_id, pos, name, shown, bucket, combined_score, is_masked) as rows for people."""
    return fields.select("document_id", "pos", label(F.col("name")).alias("field"), F.coalesce("shown", F.lit("")).alias("value"), F.coalesce("bucket", F.lit("unknown")).alias("confidence"), "combined_score", "is_masked")


def table_frame(cells: DataFrame) -> DataFrame:
    """One row a table row: its cells as 'column: value', in the order of columns."""
    ordered = F.array_sort(F.collect_list(F.struct("col_pos", F.concat(label(F.col("col_name")), F.lit(": "), F.coalesce("value", F.lit(""))).alias("t"))))
    return cells.groupBy("document_id", "table_idx", "table_name", "row_index").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " | ").alias("cells"))


def word_overlay(words: DataFrame) -> DataFrame:
    """Rectangles to draw on a page, coloured by confidence."""
    return words.select("document_id", "page", "word_idx", "x", "y", "width", "height", word_colour(F.col("confidence")).alias("colour"))


def export_name(filename: Column) -> Column:
    return F.concat(F.regexp_replace(filename, r"\.[^.]*$", ""), F.lit("_extracted_record.json"))


def exported(fields: DataFrame, masked: bool = False) -> DataFrame:
    """(document_id, record): the fields of each document as one JSON text, in their order; with masked, personal
    values as they may be shown."""
    value = F.when(F.col("is_masked"), mask_value(F.col("value"), F.col("field_type"))).otherwise(F.col("value")) if masked else F.col("value")
    rows = F.array_sort(F.collect_list(F.struct("pos", "name", value.alias("value"), "bucket")))
    return fields.groupBy("document_id").agg(F.to_json(F.transform(rows, lambda r: F.struct(r["name"].alias("name"), r["value"].alias("value"), r["bucket"].alias("bucket"))), {"ignoreNullFields": "false"}).alias("record"))


def records(results: DataFrame) -> DataFrame:
    """(document_id, file_name, record) of results (document_id, original_filename, r STRUCT): the whole stored record as JSON for
    people, and the name of the file to hand out."""
    name = export_name(F.coalesce(F.nullif("original_filename", F.lit("")), F.col("document_id").cast("string")))
    return results.select("document_id", name.alias("file_name"), F.to_json("r", {"pretty": "true", "ignoreNullFields": "false"}).alias("record"))


def _pictures(joined: DataFrame, make) -> DataFrame:
    """make(image, row) gives the pictures (name, image) of a row with pixels; what comes out is (document_id, page, name, …pixels)."""

    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                image = np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.height, r.width, r.channels)
                for name, made in make(image, r):
                    yield pd.DataFrame([(r.document_id, r.page, name, *made.shape, np.ascontiguousarray(made).tobytes())], columns=["document_id", "page", "name", "height", "width", "channels", "pixels"])

    kind = joined.schema["document_id"].dataType.simpleString()
    return joined.mapInPandas(run, f"document_id {kind}, page int, name string, height int, width int, channels int, pixels binary")


def overlays(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Pages (document_id, page, height, width, channels, pixels) of three colours with a frame around every word, by its confidence."""
    boxes = word_overlay(words).groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("word_idx", "x", "y", "width", "height", "colour"))).alias("boxes"))
    picture = pages.select("document_id", "page", "height", "width", "channels", "pixels")
    return _pictures(picture.hint("merge").join(boxes, ["document_id", "page"]), lambda image, r: [("words", pixels.with_boxes(image, [(b["x"], b["y"], b["width"], b["height"], b["colour"]) for b in r.boxes]))])


def crops(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """The part of its page around every field (document_id, name, page, x, y, width, height) that has one, with some room."""
    boxes = fields.filter("page is not null").groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("name", "x", "y", "width", "height"))).alias("boxes"))
    picture = pages.select("document_id", "page", F.col("height").alias("h"), F.col("width").alias("w"), "channels", "pixels").hint("merge").join(boxes, ["document_id", "page"])
    placed = F.transform("boxes", lambda b: F.struct(b["name"].alias("name"), crop(b["x"], b["y"], b["width"], b["height"], F.col("w"), F.col("h")).alias("part")))
    joined = picture.withColumn("boxes", F.filter(placed, lambda b: b["part"].isNotNull())).withColumnsRenamed({"h": "height", "w": "width"})
    return _pictures(joined, lambda image, r: [(b["name"], pixels.cropped(image, tuple(b["part"][side] for side in ("left", "top", "right", "bottom")))) for b in r.boxes])


def reference_names(references: DataFrame, documents: DataFrame) -> DataFrame:
    """references (answer_id, document_id) with the file's name of the document, or the start of the id where the store
    has none."""
    names = documents.groupBy("document_id").agg(F.min_by("original_filename", "seq").alias("original_filename"))
    return references.join(names, "document_id", "left").select("answer_id", "document_id", F.coalesce(F.nullif("original_filename", F.lit("")), F.substring("document_id", 1, 8)).alias("shown"))
