"""Answers to questions over the store: context, prompt, model, references.

Contexts are built on the executors. All of them are in the prompt, unless a number of documents is asked for: then those
that share most words with the question, and the prompt says how many are left out. References are looked for among all
processed documents in either case."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.operators import retrieval
from paperloom.operators.store import Store
from paperloom.plans.ingestion import RESULT
from paperloom.sources.providers import ModelProvider, Unavailable

EMPTY = "There are no processed documents yet."
FAILED = "The question could not be answered now. Please try again."
UNKNOWN = "don't have that information"
RULES = (
    "Answer from the documents below and nothing else. If they do not say, write: I don't have that information in the documents. "
    "Name the document of every value and how sure it is. Masked values are confidential. "
    'End with a line REFERENCED_DOCS: ["id", ...] of the documents that you used.'
)


def contexts(store: Store):
    """(document_id, context, seq) of all processed documents."""
    held = store.processed(RESULT)
    docs = held.select(
        "document_id", "doc_type", F.coalesce("r.original_filename", F.lit("")).alias("filename"), F.coalesce("upload_timestamp", F.lit("")).alias("upload_timestamp"),
        F.coalesce("r.is_confidential", F.lit(False)).alias("is_confidential"), F.coalesce("r.sensitivity_level", F.lit("none")).alias("sensitivity_level"),
        F.lit("personal fields").alias("reason"), F.coalesce("r.overall_status", F.lit("unknown")).alias("overall_status"), "seq", "r",
    )
    counted = store.read("corrections").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_corrections"))
    docs = docs.join(counted, "document_id", "left").fillna(0, ["n_corrections"])
    corrected = store.read("corrections").select("document_id", F.col("field_name").alias("name")).distinct().withColumn("manually_corrected", F.lit(True))
    f = docs.select("document_id", F.explode("r.extracted_fields").alias("f")).select("document_id", "f.pos", "f.name", "f.value", "f.is_masked", F.col("f.confidence.bucket").alias("bucket"), F.col("f.confidence.combined_score").alias("combined_score"))
    cells = docs.select("document_id", F.explode("r.tables").alias("c")).select("document_id", "c.table_idx", "c.table_name", "c.row_index", F.lit(0).alias("col_pos"), "c.col_name", "c.value")
    checks = docs.select("document_id", F.explode("r.cross_checks").alias("c")).select("document_id", "c.check_name", "c.passed")
    flags = docs.select("document_id", F.explode("r.tamper_flags").alias("c")).select("document_id")
    made = retrieval.context(docs.drop("r"), f.join(corrected, ["document_id", "name"], "left"), cells, checks, flags)
    return made.join(docs.select("document_id", "seq"), "document_id")


def answer(store: Store, query: str, model: ModelProvider, history: list[dict] | None = None, documents: int | None = None) -> dict:
    """answer and referenced_documents; documents bounds those in the prompt, for models that read no more."""
    held = contexts(store)
    ids = held.select("document_id", "seq")
    n = ids.count()
    if not n:
        return {"answer": EMPTY, "referenced_documents": []}
    found = (held if documents is None else retrieval.relevant(held, query, documents)).orderBy(F.desc("seq")).collect()
    left_out = f"\n\n{n - len(found)} further documents are not shown." if n > len(found) else ""
    turns = [f"{str(t.get('role', 'user')).title()}: {str(t.get('content', '')).strip()}" for t in (history or [])[-K.HISTORY_TURNS :]]
    prompt = "\n\n".join([RULES, "Conversation so far:\n" + ("\n".join(turns) or "none"), "Documents:\n" + "\n\n".join(r["context"] for r in found) + left_out, "Question: " + query])
    try:
        raw = model.complete(prompt)
    except Unavailable:
        return {"answer": FAILED, "referenced_documents": []}
    spark = store.spark
    told = spark.createDataFrame([(1, raw)], "answer_id int, raw string")
    row = retrieval.references(told, ids).first()
    named = row["referenced_documents"]
    if not named and n == 1 and UNKNOWN not in row["answer"].lower():
        named = [found[0]["document_id"]]
    return {"answer": row["answer"], "referenced_documents": named}
