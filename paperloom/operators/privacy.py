"""Personal fields, sensitivity of documents, masked views.

fields: document_id, doc_type, pos, name, value, field_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scores import is_personal, sensitivity, sensitivity_reason
from paperloom.functions.text import mask_value


def classify(fields: DataFrame) -> DataFrame:
    """(document_id, doc_type, is_confidential, sensitivity_level, masked_field_names, reason); names of personal
    fields come in their order, each once, also where the document is not confidential."""
    personal = F.when(is_personal(F.col("name"), F.col("field_type")), F.struct("pos", "name"))
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(personal)), lambda s: s["name"]))
    out = fields.groupBy("document_id", "doc_type").agg(names.alias("masked_field_names"))
    s = sensitivity(F.col("doc_type"), F.size("masked_field_names"))
    return out.select("document_id", "doc_type", s["is_confidential"].alias("is_confidential"), s["sensitivity_level"].alias("sensitivity_level"), "masked_field_names", sensitivity_reason(F.col("doc_type"), F.col("masked_field_names")).alias("reason"))


def masked_fields(fields: DataFrame, revealed: DataFrame | None = None) -> DataFrame:
    """fields with is_masked and shown: the value, or its mask where the field is personal and its document is not in
    revealed (document_id)."""
    hidden = is_personal(F.col("name"), F.col("field_type"))
    if revealed is not None:
        fields = fields.join(revealed.select("document_id").distinct().withColumn("open", F.lit(True)), "document_id", "left")
        hidden = hidden & F.col("open").isNull()
        fields = fields.withColumn("is_masked", hidden).drop("open")
    else:
        fields = fields.withColumn("is_masked", hidden)
    return fields.withColumn("shown", F.when(F.col("is_masked"), mask_value(F.col("value"), F.col("field_type"))).otherwise(F.col("value")))
