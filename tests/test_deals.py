"""Queries of words deal the documents once, not the words."""

import re

from paperloom.plans import document_queries


def test_words_are_not_dealt(spark, tmp_path):
    """F8, F9, F10, F12: words, lines and values are made where their document is; no exchange carries words or lines."""
    rows = [(i, "\n".join(" ".join(f"w{i}{j}{k}" for k in range(5)) for j in range(45))) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("words_to_lines", "page_text", "similar_line_fallback", "value_grounding", "font_zscore"):
        out = getattr(document_queries, name)(spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert dealt and not any("page" in keys or "line" in keys for keys in dealt), (name, dealt)
        assert any("doc_id" in keys for keys in dealt), (name, dealt)
    assert document_queries.words_to_lines(spark, str(tmp_path)).count() == 8 * 45
