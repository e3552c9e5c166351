"""Typed views of property leaves that are text in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf(properties: Column, path: str, kind: str = "string") -> Column:
    """A leaf of a variant or of JSON text as a type; null where the text is no JSON, the path is absent or the leaf does not fit."""
    return F.try_variant_get(properties, path, kind)


def variant(text: Column) -> Column:
    """JSON text as a variant, parsed once for all leaves; null where it is none."""
    return F.try_parse_json(text)


def money(text: Column) -> Column:
    """Amounts such as ``$1,234.50``, ``USD 1,234.50`` or ``(12.00)``, which is negative; null where there is no single amount."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^(usd|eur|gbp)\s*|\s*(usd|eur|gbp)$|[$€£,]|\s", "")
    negative = bare.rlike(r"^\(.*\)$")
    number = F.regexp_replace(bare, r"^\((.*)\)$", "$1")
    amount = F.when(number.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), number).try_cast("decimal(18,2)")
    return F.when(negative, -amount).otherwise(amount)


def date(text: Column) -> Column:
    """Dates as 2024-01-31, 01/31/2024, 31 January 2024 or January 31, 2024; null where there is none."""
    t = F.trim(text)
    shapes = ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"), (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"))
    return F.coalesce(*(F.to_date(F.try_to_timestamp(F.when(t.rlike(shape), t), F.lit(pattern))) for shape, pattern in shapes))


def bad(text: Column, typed: Column) -> Column:
    """Whether there is a leaf that its typed view could not take."""
    return text.isNotNull() & (F.trim(text) != "") & typed.isNull()
