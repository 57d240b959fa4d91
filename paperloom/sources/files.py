"""Files as rows of bytes: batch and streaming scans, type detection, hashes, metadata."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.values import exif_date, pdf_date
from paperloom.sources import pdf

TYPES = ("pdf", "png", "jpg", "jpeg")
GLOB = "*.{" + ",".join([*TYPES, *(t.upper() for t in TYPES), "txt", "pgm", "ppm"]) + "}"


def scan(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    return described(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def scan_stream(spark: SparkSession, path: str, glob: str = GLOB, files_per_batch: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return described(reader.load(path))


def is_pdf(path: Column, content: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".pdf")) | F.startswith(content, F.lit(b"%PDF"))


def described(files: DataFrame) -> DataFrame:
    """document_id (from the hash, so that a repeated run gives the same), name, type, hash, order and bytes."""
    digest = F.sha2("content", 256)
    return files.select(
        F.substring(digest, 1, 32).alias("document_id"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("original_filename"),
        digest.alias("file_hash_sha256"),
        F.col("modificationTime").alias("upload_timestamp"),
        F.when(is_pdf(F.col("path"), F.col("content")), "pdf").otherwise(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))).alias("kind"),
        "content",
    )


def _pdf_text(data: bytes, key: bytes) -> str | None:
    m = re.search(rb"/" + key + rb"\s*\(((?:\\.|[^\\)])*)\)", data)
    return m[1].decode("latin-1") if m and m[1] else None


def pdf_facts(data: bytes) -> tuple[int, str | None, str | None, str | None]:
    """Pages, creation, modification, software. Where no object can be read, what stands in the open is taken."""
    held = pdf.Document(data)
    if "Root" in held.trailer:
        return max(1, held.pages()), held.said("CreationDate"), held.said("ModDate"), held.said("Producer") or held.said("Creator")
    pages = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data))
    return max(1, pages), _pdf_text(data, b"CreationDate"), _pdf_text(data, b"ModDate"), _pdf_text(data, b"Producer") or _pdf_text(data, b"Creator")


EXIF_TAGS = {0x0132: "modified", 0x0131: "software", 0x9003: "created"}


def exif_facts(data: bytes) -> dict[str, str]:
    """Times and software of a JPEG's EXIF block, its own directory and the Exif one."""
    at = data.find(b"Exif\x00\x00")
    if at < 0:
        return {}
    tiff, out = data[at + 6 :], {}
    order = "<" if tiff[:2] == b"II" else ">"
    todo = [struct.unpack_from(order + "I", tiff, 4)[0]] if len(tiff) >= 8 else []
    seen = set()
    while todo:
        offset = todo.pop()
        if offset in seen or offset + 2 > len(tiff):
            continue
        seen.add(offset)
        for i in range(struct.unpack_from(order + "H", tiff, offset)[0]):
            entry = offset + 2 + 12 * i
            if entry + 12 > len(tiff):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
            value = struct.unpack_from(order + "I", tiff, entry + 8)[0]
            if tag == 0x8769:
                todo.append(value)
            elif tag in EXIF_TAGS and kind == 2:
                raw = tiff[entry + 8 : entry + 8 + count] if count <= 4 else tiff[value : value + count]
                out[EXIF_TAGS[tag]] = raw.split(b"\x00")[0].decode("latin-1")
    return out


def _facts(frames):
    for frame in frames:
        rows = []
        for kind, content in zip(frame["kind"], frame["content"], strict=True):
            try:
                if kind == "pdf":
                    rows.append(pdf_facts(bytes(content)))
                else:
                    x = exif_facts(bytes(content))
                    rows.append((1, x.get("created") or x.get("modified"), x.get("modified"), x.get("software")))
            except (struct.error, ValueError, RecursionError):
                rows.append((1, None, None, None))
        yield pd.DataFrame({"document_id": frame["document_id"], "kind": frame["kind"]} | {n: [r[i] for r in rows] for i, n in enumerate(("page_count", "created_text", "modified_text", "software"))})


def metadata(files: DataFrame) -> DataFrame:
    """(document_id, page_count, created, modified, software); null where a file does not say."""
    raw = files.select("document_id", "kind", "content").mapInPandas(_facts, "document_id string, kind string, page_count int, created_text string, modified_text string, software string")
    time = lambda c: F.when(F.col("kind") == "pdf", pdf_date(F.col(c))).otherwise(exif_date(F.col(c)))
    return raw.select("document_id", "page_count", time("created_text").alias("created"), time("modified_text").alias("modified"), F.nullif("software", F.lit("")).alias("software"))
