"""What leaves the store: whole records as files of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import display
from paperloom.operators.store import Store
from paperloom.plans.ingestion import RESULT


def export_records(store: Store, path: str, documents: DataFrame | None = None) -> None:
    """The whole record of every document, or of those of documents (document_id), as rows (document_id, file_name, record) of JSON
    files in a folder; one row a document, as many files as there are tasks."""
    held = store.processed(RESULT).select("document_id", F.col("r.original_filename").alias("original_filename"), "r")
    if documents is not None:
        held = held.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    display.records(held).write.mode("overwrite").json(path)
