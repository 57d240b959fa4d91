"""Confidence scores, review status and sensitivity as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.functions.text import any_contains, label, strip


def combine(ocr: Column, llm: Column, rule: Column) -> Column:
    """STRUCT of the parts, the weighted score to 4 places and its bucket. Without a rating its weight goes to
    the others; a failed rule caps the score."""
    passed = F.when(rule, 1.0).otherwise(0.0)
    rest = K.WEIGHT_OCR + K.WEIGHT_RULE
    with_llm = ocr * K.WEIGHT_OCR + llm * K.WEIGHT_LLM + passed * K.WEIGHT_RULE
    score = F.when(llm.isNotNull(), with_llm).otherwise(ocr * (K.WEIGHT_OCR / rest) + passed * (K.WEIGHT_RULE / rest))
    score = F.round(F.when(rule, score).otherwise(F.least(score, F.lit(K.RULE_CAP))), 4)
    return F.struct(F.round(ocr, 4).alias("ocr_confidence"), F.round(llm, 4).alias("llm_confidence"), rule.alias("rule_check_passed"), score.alias("combined_score"), bucket(score).alias("bucket"))


def bucket(score: Column) -> Column:
    return F.when(score >= K.GREEN, "green").when(score >= K.AMBER, "amber").otherwise("red")


def cell_score(ocr: Column, value: Column) -> Column:
    """ocr is null for a cell without a place; an empty value fails the rule and caps the score."""
    full = F.length(strip(F.coalesce(value, F.lit("")))) > 0
    score = F.coalesce(ocr, F.lit(K.CELL_UNMAPPED)) * K.CELL_OCR + F.when(full, K.CELL_RULE).otherwise(0.0)
    return F.round(F.when(full, score).otherwise(F.least(score, F.lit(K.RULE_CAP))), 4)


def clamp_rating(raw: Column) -> Column:
    """A rating from 0 to 1, null if it is no number."""
    value = raw.try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def overall_status(quality: Column, red: Column, failed: Column, high: Column) -> Column:
    """rejected, needs_review or auto_accepted, from the quality status and whether there is a red field, a failed
    check or a severe flag."""
    any_of = F.coalesce(red, F.lit(False)) | F.coalesce(failed, F.lit(False)) | F.coalesce(high, F.lit(False))
    return F.when(quality == "rejected_too_degraded", "rejected").when(any_of, "needs_review").otherwise("auto_accepted")


def is_personal(name: Column, kind: Column) -> Column:
    return F.lower(F.coalesce(kind, F.lit(""))).isin(*K.PERSONAL_TYPES) | any_contains(F.lower(name), K.PERSONAL_NAMES)


def sensitivity(doc_type: Column, n_personal: Column) -> Column:
    """STRUCT of whether a document is confidential and how sensitive it is."""
    default = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in K.SENSITIVITY.items() for x in p]), doc_type), F.lit("low"))
    high = default == "high"
    confidential = (n_personal >= 2) | high
    level = F.when(~confidential, "none").when(high | (n_personal >= 3), "high").otherwise("low")
    return F.struct(confidential.alias("is_confidential"), level.alias("sensitivity_level"))


def sensitivity_reason(doc_type: Column, names: Column) -> Column:
    high = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in K.SENSITIVITY.items() for x in p]), doc_type), F.lit("low")) == "high"
    listed = F.array_join(F.transform(names, label), ", ")
    return (
        F.when((F.size(names) > 0) & high, F.concat(label(doc_type), F.lit(" is a sensitive document type and has personal fields: "), listed))
        .when(F.size(names) > 0, F.concat(F.lit("personal fields: "), listed))
        .when(high, F.concat(label(doc_type), F.lit(" is a sensitive document type")))
        .otherwise("no personal fields")
    )


def word_colour(confidence: Column) -> Column:
    return F.when(confidence >= K.HIGH_WORD_CONFIDENCE, "green").when(confidence >= K.LOW_WORD_CONFIDENCE, "amber").otherwise("red")


def overlap(a: tuple[Column, ...], b: tuple[Column, ...], margin: int = K.OVERLAP_MARGIN) -> Column:
    """Whether box a (x, y, width, height), grown by margin, and box b share more than an edge."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    return (ax - margin + aw + 2 * margin > bx) & (bx + bw > ax - margin) & (ay - margin + ah + 2 * margin > by) & (by + bh > ay - margin)


def crop(x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column, padding: int = K.CROP_PADDING) -> Column:
    """Rectangle (left, top, right, bottom) of a box with padding, within the image; null if nothing is left."""
    left, top = F.greatest(F.lit(0), x - padding), F.greatest(F.lit(0), y - padding)
    right, bottom = F.least(image_w, x + w + padding), F.least(image_h, y + h + padding)
    inside = (w > 0) & (h > 0) & (x < image_w) & (y < image_h) & (right > left) & (bottom > top)
    return F.when(inside, F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))
