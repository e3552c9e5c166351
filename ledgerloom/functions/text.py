"""Hashes, keys and patterns of documents' text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def chunk_hash(text: Column) -> Column:
    """SHA-256 of text without case and spacing."""
    return F.sha2(normalized_text(text), 256)


def key_of(*parts: Column) -> Column:
    """SHA-256 of parts with bars between them: ids that are the same in every run."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def document_key(number: Column) -> Column:
    """A document number without case, spaces and punctuation, as "AD-1 Rev.B" and "ad 1 revb"."""
    return F.regexp_replace(F.lower(number), r"[^a-z0-9]", "")


def relation_name(relation: Column) -> Column:
    return F.replace(F.upper(relation), F.lit(" "), F.lit("_"))


def property_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def present(value: Column) -> Column:
    return value.isNotNull() & ~value.isin("", "[]")


def compact_props(props: Column) -> Column:
    """Properties without empty values."""
    return F.map_filter(props, lambda _, v: present(v))


def offset_days(text: Column) -> Column:
    """The n of an offset "event+n" or "event-n" in days, or null."""
    return F.when(text.rlike(r"[+-]\s*\d+\s*$"), F.regexp_replace(F.regexp_extract(text, r"([+-]\s*\d+)\s*$", 1), r"\s", "").cast("int"))
