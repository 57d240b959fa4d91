"""Pages set straight and made smooth, their quality, hashes and strokes, and the roll-up of pages.

images: document_id, page, height, width, channels, pixels (row-major bytes).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.operators import pixels


def grey(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    image = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(np.float64)
    return image[:, :, 0] if channels == 1 else np.floor(image[:, :, :3] @ np.array([0.299, 0.587, 0.114]) + 0.5)


def laplacian_variance(image: np.ndarray) -> float:
    """Sharpness; the border is mirrored without repeating its pixels."""
    if min(image.shape) < 2:
        return 0.0
    p = np.pad(image, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * image).var())


def _resized(image: np.ndarray, n: int) -> np.ndarray:
    """Area average on an n x n grid."""
    for axis in (0, 1):
        size = image.shape[axis]
        edges = np.linspace(0, size, n + 1)
        sums = np.concatenate((np.zeros_like(np.take(image, [0], axis)), np.cumsum(image, axis)), axis)
        low = np.minimum(np.floor(edges).astype(int), size)
        part = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        at = np.take(sums, low, axis) + part * np.take(image, np.minimum(low, size - 1), axis)
        image = np.diff(at, axis=axis) / (size / n)
    return image


def perceptual_hash(image: np.ndarray) -> str:
    """16 digits: signs of the 8 x 8 lowest frequencies of a 32 x 32 version against their median."""
    if image.size == 0:
        return K.NO_HASH
    k = np.arange(32)
    dct = np.cos(np.pi * np.outer(k, 2 * k + 1) / 64)
    low = (dct @ _resized(image, 32) @ dct.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


MEASURES = "blur_score double, skew_angle double, skew_before double, perceptual_hash string, resave_mean double, resave_percent double"
PREPARED = f"document_id string, page int, height int, width int, channels int, pixels binary, {MEASURES}"


def measures(image: np.ndarray, page: int) -> dict:
    """Of an RGB image. What a saving changes is looked for on first pages only, and null on others."""
    flat = grey(image.tobytes(), *image.shape)
    mean, percent = pixels.recompression_error(image) if page == 1 else (None, None)
    return {"blur_score": laplacian_variance(flat), "skew_angle": pixels.skew_angle(flat), "perceptual_hash": perceptual_hash(flat), "resave_mean": mean, "resave_percent": percent}


def prepared(images: DataFrame) -> DataFrame:
    """images set straight by their skew and made smooth, with the measures of what comes out and the skew before. One pass, so that
    pixels are neither read twice nor dealt; the measures alone are read without them."""

    def run(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                image = np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.height, r.width, r.channels)
                image = np.repeat(image[:, :, :1], 3, axis=2) if r.channels < 3 else image[:, :, :3]
                before = pixels.skew_angle(grey(image.tobytes(), *image.shape)) if image.size else 0.0
                image = pixels.bilateral(pixels.rotated(image, before)) if image.size else image
                yield pd.DataFrame([{"document_id": r.document_id, "page": r.page, "height": image.shape[0], "width": image.shape[1], "channels": 3, "pixels": image.tobytes(), "skew_before": before} | measures(image, r.page)])[[c.split()[0] for c in PREPARED.split(", ")]]

    return images.select("document_id", "page", "height", "width", "channels", "pixels").mapInPandas(run, PREPARED)


def stroke_boxes(words: DataFrame, fields: DataFrame) -> DataFrame:
    """(document_id, boxes, sample): the fields (document_id, name, x, y, width, height) of a document that are large enough, and its
    first STROKE_SAMPLE words, whatever their page."""
    order = Window.partitionBy("document_id").orderBy("page", "word_idx")
    first = words.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= K.STROKE_SAMPLE)
    sample = first.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "width", "height"))).alias("sample"))
    boxes = fields.filter(f"width >= {K.FIELD_LEAST_SIDE} and height >= {K.FIELD_LEAST_SIDE}").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("name", "x", "y", "width", "height"))).alias("boxes"))
    return boxes.join(sample, "document_id", "left")


def strokes_of(pictures: DataFrame) -> DataFrame:
    """(document_id, name, stroke, stroke_mean, stroke_std) of first pages (document_id, height, width, channels, pixels) with their
    stroke_boxes; of fields that begin on the picture."""

    def run(pdfs):
        known: dict = {}
        for pdf in pdfs:
            found = []
            for r in pdf.itertuples():
                image = grey(bytes(r.pixels), r.height, r.width, r.channels)
                cut = lambda b: image[max(0, b["y"]) :, max(0, b["x"]) :][: b["height"], : b["width"]]  # noqa: B023, E731
                inside = [b for b in (r.sample if r.sample is not None else ()) if min(b["width"], b["height"]) >= K.STROKE_LEAST_SIDE and max(0, b["x"]) + b["width"] <= r.width and max(0, b["y"]) + b["height"] <= r.height]
                boxes = [b for b in r.boxes if max(0, b["x"]) < r.width and max(0, b["y"]) < r.height]
                widths = pixels.stroke_widths([cut(b) for b in (*inside, *boxes)], known)
                seen = [s for s in widths[: len(inside)] if s > K.STROKE_LEAST]
                mean, std = (float(np.mean(seen)), float(np.std(seen))) if seen else (None, None)
                found += [(r.document_id, b["name"], s, mean, std) for b, s in zip(boxes, widths[len(inside) :], strict=True)]
            yield pd.DataFrame(found, columns=["document_id", "name", "stroke", "stroke_mean", "stroke_std"])

    kind = pictures.schema["document_id"].dataType.simpleString()
    return pictures.select("document_id", "height", "width", "channels", "pixels", "boxes", "sample").mapInPandas(run, f"document_id {kind}, name string, stroke double, stroke_mean double, stroke_std double")


def strokes(pages: DataFrame, words: DataFrame, fields: DataFrame) -> DataFrame:
    """strokes_of the first page of pages; mean and deviation are those of the first words of the document, and null where none of
    them has a stroke. Boxes are dealt to pictures by document, as lists."""
    picture = pages.filter("page = 1").select("document_id", "height", "width", "channels", "pixels")
    # Pictures are larger than Spark takes them to be: they are dealt and pass by the boxes, neither broadcast nor sorted.
    return strokes_of(picture.join(stroke_boxes(words, fields).hint("shuffle_hash"), "document_id"))


def rollup(pages: DataFrame) -> DataFrame:
    """pages: document_id, page, blur_score, skew_angle. The worst page counts; of equally skewed pages the first."""
    out = pages.groupBy("document_id").agg(
        F.bool_or(F.col("blur_score") < K.BLUR_LIMIT).alias("is_too_degraded"),
        F.round(F.min("blur_score"), 2).alias("blur_score"),
        F.round(F.max_by("skew_angle", F.struct(F.abs("skew_angle"), -F.col("page"))), 2).alias("skew_angle_degrees"),
    )
    return out.withColumn("status", F.when(F.col("is_too_degraded"), "rejected_too_degraded").otherwise("ok"))
