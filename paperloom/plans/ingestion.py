"""The whole way of a document: files, quality gate, duplicates, recognition, extraction, scores, checks, store.

Every stage is one lazy plan; the results of providers are written, so that a model or recogniser is not asked again
when a later plan is computed or an executor is lost."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import checks, dedup, extraction, grounding, layout, privacy, quality, review, scoring
from paperloom.operators.store import Store, stamped
from paperloom.scratch import written
from paperloom.sources import files as sources
from paperloom.sources.providers import ImagePages, ModelProvider, PageProvider, WordProvider, ask, read_pages, read_words

BOX = "struct<page:int,x:int,y:int,width:int,height:int>"
RESULT = (
    "document_id string, doc_type string, upload_timestamp string, original_filename string, "
    f"extracted_fields array<struct<pos:int,name:string,value:string,field_type:string,raw_ocr_text:string,bbox:{BOX},confidence:struct<ocr_confidence:double,llm_confidence:double,rule_check_passed:boolean,combined_score:double,bucket:string>,is_masked:boolean>>, "
    "tables array<struct<table_idx:int,table_name:string,row_index:int,col_name:string,value:string,confidence:double>>, "
    f"table_scores array<struct<table_idx:int,table_confidence:double,bbox:{BOX}>>, "
    "cross_checks array<struct<check_name:string,fields_compared:array<string>,expected_relationship:string,passed:boolean,detail:string,discrepancy:string>>, tamper_flags array<struct<flag_type:string,affected_field:string,evidence:string,severity:string>>, "
    "is_confidential boolean, sensitivity_level string, overall_status string"
)


@dataclass
class Providers:
    """What recognises words and what answers prompts are services to be named; pictures are read by the library."""

    words: WordProvider
    model: ModelProvider
    pages: PageProvider = field(default_factory=ImagePages)
    at_once: int = 1  #: prompts that a task has under way


def _nested(df: DataFrame, name: str, columns: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v"))))
    return df.groupBy("document_id").agg(F.transform(rows, lambda r: r["v"]).alias(name))


def numbered(rows: DataFrame, order: list[str], store: Store, batch: int) -> DataFrame:
    """rows with seq: from the last one in the store on, in the order of columns. Rows are dealt by ranges and numbered in each,
    from the number of rows in the ranges before."""
    last = store.read("documents", batch).agg(F.max("seq")).first()[0] or 0
    ranged = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    counts = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    before, offsets = last, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    offsets = rows.sparkSession.createDataFrame(offsets, "range int, before long")
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "range").withColumn("seq", F.col("before") + own).drop("range", "before")


def process(files: DataFrame, store: Store, batch: int, providers: Providers) -> DataFrame:
    """Ingest files (as sources.files gives them) as one batch; returns (document_id, outcome) of every file, where
    outcome is unreadable (no decoder gave a page), rejected, duplicate or the review status. A batch may run again: it
    gives the same rows, whatever an earlier try has written."""
    p = providers
    files = written(files.dropDuplicates(["document_id"]), "files")
    pages = written(quality.prepared(read_pages(files, p.pages)), "pages")
    measured = pages.drop("height", "width", "channels", "pixels")
    rated = quality.rollup(measured)
    first_hash = measured.filter("page = 1").select("document_id", "perceptual_hash")
    meta = files.select("document_id", "original_filename", "file_hash_sha256", "upload_timestamp", "kind").join(first_hash, "document_id", "left").join(rated.select("document_id", "status"), "document_id", "left")
    # Plain text has no looks: pictures of it do not tell texts apart.
    meta = meta.withColumn("perceptual_hash", F.when(F.col("kind") != "txt", F.col("perceptual_hash"))).withColumn("status", F.coalesce("status", F.lit("unreadable")))
    meta = written(numbered(meta.drop("kind"), ["upload_timestamp", "document_id"], store, batch), "meta")
    good = meta.filter("status = 'ok'").select("document_id", F.col("file_hash_sha256").alias("file_hash"), "perceptual_hash", "seq")
    # What an earlier try of this batch has written does not count.
    stored = store.current(batch).select("document_id", F.col("file_hash_sha256").alias("file_hash"), "perceptual_hash", "seq")
    repeats = dedup.find_duplicates(good, stored)
    # Within the batch documents come one by one, as they would from a reader.
    kept = dedup.accepted_in_order(good.join(repeats, "document_id", "left_anti"))
    kept = written(kept.join(stored.select("document_id"), "document_id", "left_anti"), "kept")
    accepted = files.join(kept, "document_id", "left_semi")

    words = written(layout.without_noise(read_words(accepted, p.words)), "words")
    lines = written(layout.words_to_lines(words), "lines")
    texts = written(kept.join(layout.document_texts(layout.page_texts(lines)), "document_id", "left"), "texts")
    typed = ask(texts.select("document_id", extraction.classification_prompt(F.coalesce("document_text", F.lit(""))).alias("prompt")), p.model, at_once=p.at_once)
    typed = written(texts.join(typed, "document_id", "left").select("document_id", "document_text", extraction.doc_type_of(F.coalesce("raw", F.lit("other")), F.col("document_text")).alias("doc_type")), "types")
    examples = review.examples(store.read("corrections"))
    prompts = typed.join(examples, "doc_type", "left").select("document_id", extraction.extraction_prompt(F.col("doc_type"), F.col("document_text"), F.col("examples")).alias("prompt"))
    raw = ask(prompts, p.model, at_once=p.at_once, tries=2, good=lambda text: re.search(r"\{.*\}", text, re.S) is not None)
    answers = written(typed.select("document_id", "doc_type").join(raw, "document_id", "left").select("document_id", "doc_type", extraction.parse_answer(F.col("raw")).alias("answer")), "answers")

    fields = written(extraction.fields_of(answers), "fields")
    cells = written(extraction.cells_of(answers), "cells")
    key = ["document_id", "name"]
    placed = written(grounding.ground(fields, lines, words), "placed")
    fields = fields.join(placed.drop("method", "score"), key, "left").withColumn("raw_ocr_text", F.coalesce("raw_text", "value"))
    asked = fields.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "value"))).alias("f")).join(typed, "document_id")
    rating = ask(asked.select("document_id", extraction.rating_prompt(F.col("doc_type"), F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))), F.coalesce("document_text", F.lit(""))).alias("prompt")), p.model, at_once=p.at_once)
    rating = written(rating.select("document_id", F.explode(F.from_json(extraction.clean_json(F.col("raw")), "map<string,string>")).alias("name", "rating")), "ratings")
    scored = written(scoring.score_fields(fields, words, scoring.ratings(rating)), "scored")

    cell_key = F.concat_ws("/", "table_idx", "row_index", "col_pos")
    cell_places = grounding.ground(cells.select("document_id", cell_key.alias("name"), "value"), lines, words).select("document_id", "name", "page", "x", "y", "width", "height")
    located = cells.withColumn("name", cell_key).join(cell_places, key, "left")
    boxed = located.filter("x is not null")
    cell_scores = scoring.score_cells(located.join(grounding.field_confidence(boxed.select("document_id", "name", "page", "x", "y", "width", "height"), words), key, "left"))

    box = F.when(F.col("page").isNotNull(), F.struct(*[F.col(c).cast("int").alias(c) for c in ("page", "x", "y", "width", "height")]))
    table_scores = scoring.score_tables(cell_scores).join(scoring.table_boxes(located), ["document_id", "table_idx"], "left").withColumn("bbox", box)

    tests = checks.cross_checks(typed.select("document_id", "doc_type"), fields, cells)
    boxes = scored.filter("page is not null")
    strokes = quality.strokes(pages, words, boxes)
    flags = checks.metadata_flags(sources.metadata(accepted)).unionByName(checks.recompression_flags(measured.join(kept.select("document_id"), "document_id", "left_semi")))
    flags = written(flags.unionByName(checks.font_flags(boxes, words, strokes)), "flags")
    secret = privacy.classify(fields.select("document_id", "doc_type", "pos", "name", "value", "field_type"))
    corrected = review.overlay(scored.select("document_id", "pos", "name", "value", F.col("confidence.combined_score").alias("combined_score"), F.col("confidence.bucket").alias("bucket")), store.read("corrections"))
    status = review.review_status(kept.withColumn("quality_status", F.lit("ok")), corrected, tests, flags)

    latest = corrected.select("document_id", "name", F.col("value").alias("new_value"), F.col("combined_score").alias("new_score"), F.col("bucket").alias("new_bucket"))
    final = scored.join(latest, key).withColumn("value", F.col("new_value")).withColumn("confidence", F.col("confidence").withField("combined_score", F.col("new_score")).withField("bucket", F.col("new_bucket")))
    final = privacy.masked_fields(final).withColumn("bbox", F.when(F.col("page").isNotNull(), F.struct(*[F.col(c).cast("int").alias(c) for c in ("page", "x", "y", "width", "height")])))
    parts = [
        _nested(final, "extracted_fields", ("pos", "name", "value", "field_type", "raw_ocr_text", "bbox", "confidence", "is_masked"), ("pos",)),
        _nested(cell_scores, "tables", ("table_idx", "table_name", "row_index", "col_name", "value", "confidence"), ("table_idx", "row_index", "col_pos")),
        _nested(table_scores, "table_scores", ("table_idx", "table_confidence", "bbox"), ("table_idx",)),
        _nested(tests, "cross_checks", checks.RECORD, ("check_name",)),
        _nested(flags, "tamper_flags", ("flag_type", "affected_field", "evidence", "severity"), ("flag_type", "affected_field", "evidence")),
        secret.select("document_id", "is_confidential", "sensitivity_level"),
        status,
    ]
    result = kept.join(meta, "document_id").join(typed.select("document_id", "doc_type"), "document_id").withColumn("upload_timestamp", F.date_format("upload_timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    for part in parts:
        result = result.join(part, "document_id", "left")
    columns = [f.name for f in T.StructType.fromDDL(RESULT).fields]
    result = written(result.select("document_id", "file_hash_sha256", "perceptual_hash", "upload_timestamp", "doc_type", "seq", "overall_status", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("full_result_json")), "results")
    uploaded = result.select("document_id", F.lit("document_uploaded").alias("action"), F.lit("system").alias("actor"), F.col("upload_timestamp").alias("timestamp"), F.col("doc_type").alias("detail"), "seq")
    events = stamped(review.audit_once(uploaded, store.read("audit_log", batch), "document_uploaded"))
    store.commit({"audit_log": events, "documents": result}, batch, "uploaded")
    outcome = F.when(F.col("status") == "unreadable", "unreadable").when(F.col("status") != "ok", "rejected").otherwise(F.coalesce("overall_status", F.lit("duplicate")))
    return meta.join(result.select("document_id", "overall_status"), "document_id", "left").select("document_id", "original_filename", outcome.alias("outcome"))
