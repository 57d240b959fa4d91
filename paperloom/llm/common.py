"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP_BITS = 32768  #: bits in one bitmap of bitmap_construct_agg
BITS_PER_KEY = 16
PROBE_BITS = 1 << 26  #: bits of a filter that is broadcast, at most: 8 MB
WORD = r"[^\x20\x09-\x0D]+"  #: a word, in the patterns of Java, RE2 and Python
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. Pure ASCII takes the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; 0 is the held-out fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned crc32 of a text of ASCII characters."""
    byte_list = f"list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT))"
    one_bit = "CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295, {byte_list}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: {one_bit})), 4294967295)"


def bitmap_slot(buckets: int, key: str) -> tuple[Column, Column]:
    """Bitmap (bucket) of a key and its bit in there."""
    at = F.pmod(F.xxhash64(key), F.lit(buckets * BITMAP_BITS))
    return F.floor(at / BITMAP_BITS).alias("bucket"), (at % BITMAP_BITS).alias("bit")


def bitmap_has(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0, F.lit(False))


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows with maybe: false only where the key is surely not in wanted. The filter has PROBE_BITS bits at most, so that it
    may be broadcast; with more keys than it holds more rows are maybe in."""
    buckets = max(1, min(PROBE_BITS, wanted.count() * BITS_PER_KEY) // BITMAP_BITS)
    bucket, bit = bitmap_slot(buckets, key)
    bits = wanted.select(bucket, bit).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    probed = rows.select("*", bucket.alias("_bucket"), bit.alias("_bit")).join(F.broadcast(bits.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))), "_bucket", "left")
    return probed.select(*[F.col(c) for c in rows.columns], bitmap_has(F.col("_bits"), F.col("_bit")).alias("maybe"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, rows: int | None = None) -> DataFrame:
    """mapInArrow with per-task state: make() runs once a task and returns the function for batches,
    which returns columns by name. Memory holds one Arrow batch at a time, and what the function makes of `rows` of its rows
    (None: of all); at the end of a task it is given back."""
    from pyspark.sql.types import _parse_datatype_string  # noqa: PLC2701
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows or max(1, b.num_rows))):
            if batch.num_rows:
                out = work(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in target], schema=target)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(run, schema)
