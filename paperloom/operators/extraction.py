"""From model output to typed fields and table cells: prompts, JSON cleaning, schema lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.functions.text import doc_type_label, expected_type, nullish, strip

ANSWER = "struct<fields:map<string,string>,tables:array<struct<table_name:string,rows:array<map<string,string>>>>>"


def clean_json(raw: Column) -> Column:
    """The text from the first { to the last }, without code fences; null if there is none."""
    text = F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json|JSON)?\s*", ""), r"\s*```$", "")
    first, last = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
    return F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), F.substring(text, first, last - first + 1))


def parse_answer(raw: Column) -> Column:
    """STRUCT of fields and tables of a model's answer, null if it is no JSON object. Fields or tables that are
    themselves JSON texts are decoded."""
    # Both parts as texts, which keeps the order of fields; objects of the variant type would sort them. What a lambda is
    # given is computed once.
    parts = F.from_json(clean_json(raw), "fields string, tables string, _corrupt_record string")

    def answer(p: Column) -> Column:
        fields = F.from_json(F.coalesce(p["fields"], F.lit("")), "map<string,string>")
        tables = F.from_json(F.coalesce(p["tables"], F.lit("")), "array<struct<table_name:string,rows:array<map<string,string>>>>")
        return F.when(p.isNotNull() & p["_corrupt_record"].isNull(), F.struct(fields.alias("fields"), tables.alias("tables")))

    return F.get(F.transform(F.array(parts), answer), F.lit(0))


def entries(m: Column) -> Column:
    """Entries of a map in order; of a repeated key the last value, at the place of the first. Only maps that repeat a key are searched
    for every key."""
    last = lambda k: F.element_at(F.filter(F.map_entries(m), lambda e: e["key"] == k), -1)
    keys = F.array_distinct(F.map_keys(m))
    return F.when(F.size(keys) == F.size(m), F.map_entries(m)).otherwise(F.transform(keys, last))


def fields_of(answers: DataFrame) -> DataFrame:
    """(document_id, doc_type, pos, name, value, field_type) of answers (document_id, doc_type, answer STRUCT);
    null-like values are left out."""
    rows = answers.select("document_id", "doc_type", F.posexplode(entries(F.col("answer.fields"))).alias("pos", "e")).select("document_id", "doc_type", "pos", F.col("e.key").alias("name"), F.col("e.value").alias("value"))
    return rows.filter(~nullish(F.col("value"))).withColumn("field_type", expected_type(F.col("doc_type"), F.col("name"), F.col("value")))


def skipped_fields(answers: DataFrame) -> DataFrame:
    """(document_id, name) of fields whose values are null-like."""
    rows = answers.select("document_id", F.explode(entries(F.col("answer.fields"))).alias("e"))
    return rows.filter(nullish(F.col("e.value"))).select("document_id", F.col("e.key").alias("name"))


def cells_of(answers: DataFrame) -> DataFrame:
    """(document_id, table_idx, table_name, row_index, col_pos, col_name, value); rows count from 1."""
    tables = answers.select("document_id", F.posexplode("answer.tables").alias("table_idx", "t"))
    rows = tables.select("document_id", "table_idx", F.coalesce("t.table_name", F.concat(F.lit("table_"), (F.col("table_idx") + 1).cast("string"))).alias("table_name"), F.posexplode("t.rows").alias("row", "cells"))
    cells = rows.select("document_id", "table_idx", "table_name", (F.col("row") + 1).alias("row_index"), F.posexplode(entries(F.col("cells"))).alias("col_pos", "c"))
    return cells.select("document_id", "table_idx", "table_name", "row_index", "col_pos", F.col("c.key").alias("col_name"), F.col("c.value").alias("value")).filter("value is not null")


def classification_prompt(text: Column) -> Column:
    return F.concat(F.lit("Name the type of this document with one of: " + ", ".join(K.DOC_TYPES) + ".\n\n"), F.substring(text, 1, K.PROMPT_CHARS))


def doc_type_of(raw: Column, text: Column) -> Column:
    """An empty document is other, whatever the model says."""
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", "other").otherwise(doc_type_label(raw))


def _schema_text(doc_type: str) -> str:
    schema = K.SCHEMAS[doc_type]
    fields = ", ".join(schema["fields"]) or "every labelled value, with short lower-case names"
    tables = "; ".join(f"{t} ({', '.join(c)})" for t, c in schema["tables"].items()) or "those that the document has"
    return f"Document type: {doc_type}\nFields: {fields}\nTables: {tables}\n"


RULES = 'Give one JSON object {"fields": {name: value}, "tables": [{"table_name": name, "rows": [{column: value}]}]} and nothing else. A value that the text does not have is null.\n\n'


def extraction_prompt(doc_type: Column, text: Column, examples: Column | None = None) -> Column:
    """Type, wanted fields and tables, earlier corrections if there are any, rules, and the whole text."""
    known = F.create_map(*[F.lit(x) for t in K.DOC_TYPES for x in (t, _schema_text(t))])
    head = F.coalesce(F.element_at(known, doc_type), F.lit(_schema_text("other")))
    memory = F.lit("") if examples is None else F.when(F.coalesce(examples, F.lit("")) == "", "").otherwise(F.concat(F.lit("Earlier corrections:\n"), examples, F.lit("\n")))
    return F.concat(head, memory, F.lit(RULES), F.coalesce(text, F.lit("")))


def rating_prompt(doc_type: Column, fields: Column, text: Column) -> Column:
    """fields: ARRAY<STRUCT<name, value>>."""
    listed = F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit(": "), F.coalesce(f["value"], F.lit("null")))), "\n")
    return F.concat(F.lit("Document type: "), doc_type, F.lit("\nFor each field give how surely the text has its value, from 0 to 1, as one JSON object.\n"), listed, F.lit("\n\n"), F.substring(text, 1, K.PROMPT_CHARS))
