"""The corpus pipeline: language identification, exact and near deduplication, masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. Rows with a null id are never dropped as copies of others. Of rows that repeat an id each text
stands for itself: one is dropped only if its own text is a copy, and rows of one id and text leave one. Tokenised packing cannot be
expressed in SQL, so ORACLE_SQL is None; tests compare run() with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup, language_id, packing, pii, shingle_dedup
from paperloom.llm.common import ascii_lower, documents, fold, maybe_in
from paperloom.scratch import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.05  #: share of a text's n-grams that speak for its language; below it the text is rejected


def _without(docs: DataFrame, dropped: DataFrame, digest: Column) -> DataFrame:
    """docs (with further columns) without the rows whose id and digest are in dropped (doc_id, digest)."""
    dropped = written(dropped.distinct(), "dropped")
    marked = maybe_in(docs, dropped, "doc_id")
    # Texts whose ids are surely not dropped are not dealt.
    rest = marked.filter("maybe").drop("maybe").withColumn("digest", digest).join(dropped, ["doc_id", "digest"], "left_anti")
    return marked.filter("not maybe").drop("maybe").withColumn("digest", digest).unionByName(rest)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or known n-grams go. Where no labelled text is there
    to learn from, only those without letters go."""
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs.filter(fold(F.col("doc_id")) != 0))
    if not model.masks.any():
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.predicted(docs, model, *COLUMNS)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; of its rows with that id, the least."""
    found = written(exact_dedup.exact_duplicates(docs), "exact-found")
    rest = _without(docs, found.filter("not kept").select("doc_id", "digest"), exact_dedup.sha256_digest(ascii_lower(F.col("text"))))
    repeated = found.filter("kept and doc_id is not null and group_size > 1").groupBy("doc_id", "digest").count().filter("count > 1")
    repeated = written(repeated.select("doc_id", "digest"), "exact-repeated")
    if not repeated.isEmpty():
        others = [c for c in COLUMNS if c != "doc_id"]
        least = rest.join(repeated, ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.min(F.struct(*others)).alias("row"))
        rest = rest.join(repeated, ["doc_id", "digest"], "left_anti").select(*COLUMNS).unionByName(least.select("doc_id", "row.*"))
    return rest.select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of similar shingles of five words, the one with the smallest id; found by
    SimHash fingerprints and their Golay-code keys, then by wider keys, all verified."""
    dropped = shingle_dedup.near_duplicates(docs).filter("not kept").select("doc_id", "digest")
    return _without(docs, dropped, shingle_dedup.text_digest()).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars is that of the new text."""
    masked = pii.masked_text(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places in windows."""
    return packing.packed(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("personal_data", personal_data), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
