"""Text expressions: normal forms, null-like values, labels, masks, types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import constants as K


def strip(value) -> Column:
    """Without white space at both ends."""
    return F.trim(value, F.lit(" \t\n\r\x0b\x0c"))


def nullish(value: Column) -> Column:
    """Null, blank, 'null' or 'none' in any case."""
    return value.isNull() | F.lower(strip(value)).isin("null", "none", "")


def normalised(value: Column) -> Column:
    """Lower case without anything but letters, digits and underscores of any script."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}_]", "")


def label(name: Column) -> Column:
    """A name for people: blanks for underscores, and every run of letters with a capital first, behind digits and marks too."""
    runs = F.regexp_extract_all(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def any_contains(value: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(w)) for w in words])


def infer_type(name: Column, value: Column) -> Column:
    """Type by words in the field's name, else by the form of its value, else text."""
    low, val = F.lower(name), F.lower(F.coalesce(value, F.lit("none")))
    out = None
    for kind, words in K.NAME_HINTS:
        cond = any_contains(low, words)
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.when(val.rlike(K.AMOUNT_VALUE), "amount").when(val.rlike(K.DATE_VALUE), "date").otherwise("text")


def expected_type(doc_type: Column, name: Column, value: Column) -> Column:
    """The schema's type of a field, else the inferred one."""
    known = F.create_map(*[F.lit(x) for t, s in K.SCHEMAS.items() for f, k in s["fields"].items() for x in (f"{t}/{f}", k)])
    return F.coalesce(F.element_at(known, F.concat(doc_type, F.lit("/"), name)), infer_type(name, value))


def doc_type_label(raw: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(strip(raw)), "[^a-z_]", "")
    return F.when(cleaned.isin(*K.DOC_TYPES), cleaned).otherwise("other")


def mask_value(value: Column, kind: Column) -> Column:
    """What may be shown of a sensitive value."""
    v, t = strip(value), F.lower(strip(kind))
    bare = F.regexp_replace(v, r"[\s-]", "")
    words = F.split(v, r"\s+")
    stars = lambda w, least: F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(w) - 1, F.lit(least))))
    n = F.length(v)
    return (
        F.when(value.isNull(), "")
        .when(nullish(value), v)
        .when(t.isin("id_number", "account_number", "id"), F.concat(F.lit("XXXX-XXXX-"), F.when(F.length(bare) <= 4, bare).otherwise(F.right(bare, F.lit(4)))))
        .when((t == "name") & (F.size(words) > 1), F.array_join(F.transform(words, lambda w: stars(w, 3)), " "))
        .when(t == "name", stars(v, 6))
        .when(t == "date", "XX/XX/XXXX")
        .when(t.isin("amount", "salary", "pay"), F.concat(F.regexp_extract(v, r"^([\$₹€£¥A-Z]{1,3}\s*)", 1), F.lit("**,***.**")))
        .when(n <= 4, F.repeat(F.lit("*"), n))
        .otherwise(F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(v, F.lit(1))))
    )


def snippet(text: Column) -> Column:
    """One line of at most 80 characters."""
    one = strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(one) > K.SNIPPET_CHARS, F.concat(F.substring(one, 1, K.SNIPPET_CHARS - 3), F.lit("..."))).otherwise(one)
