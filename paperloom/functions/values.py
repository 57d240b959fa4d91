"""Amounts, dates and rule checks as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.functions.text import nullish, strip

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_Y, _M, _D = r"(\d{4})", r"(1[0-2]|0[1-9]|[1-9])", r"(3[01]|[12]\d|0[1-9]|[1-9])"
_SHORT, _LONG = "(" + "|".join(m[:3] for m in MONTHS) + ")", "(" + "|".join(MONTHS) + ")"
#: Patterns in order, with the places of year, month and day; day before month comes first.
DATE_FORMS = (
    (rf"^{_Y}-{_M}-{_D}$", (1, 2, 3)),
    (rf"^{_D}/{_M}/{_Y}$", (3, 2, 1)),
    (rf"^{_M}/{_D}/{_Y}$", (3, 1, 2)),
    (rf"^{_D}-{_M}-{_Y}$", (3, 2, 1)),
    (rf"^{_Y}/{_M}/{_D}$", (1, 2, 3)),
    (rf"(?i)^{_D}\s+{_SHORT}\s+{_Y}$", (3, 2, 1)),
    (rf"(?i)^{_D}\s+{_LONG}\s+{_Y}$", (3, 2, 1)),
    (rf"(?i)^{_SHORT}\s+{_D}\s+{_Y}$", (3, 1, 2)),
    (rf"(?i)^{_LONG}\s+{_D}\s+{_Y}$", (3, 1, 2)),
    (rf"^{_Y}{_M}{_D}$", (1, 2, 3)),
)
FLOAT = r"(?i)^[+-]?(?:nan|inf(?:inity)?|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:e[+-]?\d(?:_?\d)*)?)$"


def parse_amount(value: Column) -> Column:
    """Everything but digits, points and minus signs is dropped; null if no number is left."""
    return F.regexp_replace(value, "[^0-9.-]", "").try_cast("double")


def parse_date(value: Column) -> Column:
    """Commas and points are dropped first; then the forms in order."""
    text = F.regexp_replace(strip(value), "[,.]", "")
    found = []
    for pattern, (y, m, d) in DATE_FORMS:
        month = F.regexp_extract(text, pattern, m)
        if "jan" in pattern:
            month = F.array_position(F.array(*[F.lit(x[:3]) for x in MONTHS]), F.substring(F.lower(month), 1, 3)).cast("string")
        ymd = F.concat_ws("-", F.regexp_extract(text, pattern, y), month, F.regexp_extract(text, pattern, d))
        found.append(F.when(text.rlike(pattern), F.try_to_timestamp(ymd, F.lit("yyyy-M-d")).cast("date")))
    return F.coalesce(*found)


def rule_passed(value: Column, kind: Column) -> Column:
    """Whether a value has the form of its type; an unknown type has any."""
    v, t = strip(value), F.lower(kind)
    amount = strip(F.regexp_replace(F.regexp_replace(v, r"[$₹€£¥,\s]", ""), "(?i)usd|inr|eur|gbp|cad|aud", ""))
    n = F.length(v)
    return (
        F.when(nullish(value), False)
        .when(t == "date", parse_date(v).isNotNull() | v.rlike(K.DATE_LIKE))
        .when(t == "amount", amount.rlike(FLOAT))
        .when(t == "id_number", (n >= 2) & v.rlike("[A-Za-z0-9]"))
        .when(t == "name", n.between(2, 100) & v.rlike("[A-Za-z]"))
        .otherwise(True)
    )


def pdf_date(value: Column) -> Column:
    """D:YYYYMMDD[HHMMSS]...; the offset is ignored and the time taken as UTC."""
    digits = F.regexp_replace(strip(value), r"^D:|'", "")
    full, day = F.regexp_extract(digits, r"^(\d{14})", 1), F.regexp_extract(digits, r"^(\d{8})", 1)
    return F.when(full != "", F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss"))).otherwise(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("yyyyMMdd")))


def exif_date(value: Column) -> Column:
    return F.try_to_timestamp(strip(value), F.lit("yyyy:MM:dd HH:mm:ss"))


ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)([+-]\d{2}:\d{2})?)?$"


def iso_date(value: Column) -> Column:
    """An ISO date or time as an instant. Z is an offset of zero, and so is none; null if the text is no such date."""
    text = F.regexp_replace(strip(value), "Z", "+00:00")
    day, time, offset = (F.regexp_extract(text, ISO, i) for i in (1, 2, 3))
    time = F.when(time == "", "00:00:00").when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time)
    return F.when(text.rlike(ISO), F.concat(day, F.lit("T"), time, F.when(offset == "", "+00:00").otherwise(offset)).try_cast("timestamp"))


def mean4(total_units: Column, n: Column) -> Column:
    """Mean to 4 places, half up, from a sum in units of 0.0001: whole numbers, so order cannot change it."""
    return F.floor((2 * total_units + n) / (2 * n)) / 10000.0


def units(confidence: Column) -> Column:
    return F.round(confidence * 10000).cast("long")
