"""The registered queries of the engine and the SQL that says what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART = 8 << 20  #: bytes of text that one task works on, where rows are made of its words


def dealt(rows: DataFrame, key: str, text: str) -> DataFrame:
    """rows by key, in parts of about PART bytes of text, so that what is made of a text needs no further deal and a task's memory
    does not grow with the table."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, size // PART + 1), key)


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _load() -> None:
    from paperloom.plans import document_queries, picture_queries, review_queries, value_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
