"""Chunks of documents: structure, tables, forms, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import chunk_hash, key_of

HEADING = r"^(#+ .*|[0-9]+(\.[0-9]+)*\.? [A-Z].*|(SECTION|ARTICLE|EXHIBIT|APPENDIX)\b.*)$"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line) of the non-empty lines."""
    d = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return d.filter(F.trim("line") != "")


def sectioned(rows: DataFrame, key: str, heading: Column) -> DataFrame:
    """Lines with a section number, which grows at headings, and the last heading above (their own at headings)."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("heading", F.when(heading, F.col("line")))
    return marked.withColumn("section", F.sum(F.when(F.col("heading").isNotNull(), 1).otherwise(0)).over(w)).withColumn("section_path", F.last("heading", ignorenulls=True).over(w))


def structure_chunks(rows: DataFrame, key: str) -> DataFrame:
    """One chunk per section: its text, place, hash and a deterministic id."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    c = rows.groupBy(key, "section").agg(F.first("section_path", ignorenulls=True).alias("section_path"), F.array_join(ordered, "\n").alias("text"), F.count("*").alias("n_lines"))
    return c.withColumn("chunk_hash", chunk_hash(F.col("text"))).withColumn("chunk_id", key_of(F.col(key), F.col("section_path"), F.col("section")))


def content_type(text: Column) -> Column:
    """prose, table, form, signature or boilerplate by signs in the text."""
    return (
        F.when(text.rlike(r"(?i)\b(signed by|signature|/s/)"), "signature")
        .when(F.length(text) - F.length(F.regexp_replace(text, r"\|", "")) >= 3, "table")
        .when(text.rlike(r"(?m)^[^:\n]{1,40}:\s*\S"), "form")
        .when(text.rlike(r"(?i)licen[sc]|all rights reserved|confidential"), "boilerplate")
        .otherwise("prose")
    )


def row_groups(tables: DataFrame, key: str, n: int) -> DataFrame:
    """Tables (key, header, rows) cut into groups of n rows, each with the header: (key, part, text)."""
    starts = F.when(F.size("rows") > 0, F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / n).cast("int"))).otherwise(F.array().cast("array<int>"))
    t = tables.select(key, "header", "rows", F.explode(starts).alias("part"))
    return t.select(key, "part", F.concat_ws("\n", "header", F.array_join(F.slice("rows", F.col("part") * n + 1, n), "\n")).alias("text"))


def form_fields(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field, value) of lines "field: value"; a field's first value wins."""
    d = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    d = d.select(key, "pos", F.trim(F.regexp_extract("line", r"^([^:]{1,40}):\s*(\S.*)$", 1)).alias("field"), F.trim(F.regexp_extract("line", r"^([^:]{1,40}):\s*(\S.*)$", 2)).alias("value"))
    return d.filter("field <> ''").groupBy(key, "field").agg(F.min_by("value", "pos").alias("value"))


def signature_edges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(source, relation, target, signed_on) of "Signed by NAME on YYYY-MM-DD"."""
    pattern = r"(?i)signed by ([A-Z][\w .-]*?) on (\d{4}-\d{2}-\d{2})"
    d = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias("s"))
    return d.select(F.regexp_extract("s", pattern, 1).alias("source"), F.lit("SIGNED").alias("relation"), F.col(key).cast("string").alias("target"), F.to_date(F.regexp_extract("s", pattern, 2)).alias("signed_on"))


def boilerplate(rows: DataFrame, doc: str, text: Column, least: int) -> DataFrame:
    """(chunk_hash, documents, lines) of text that at least so many documents share."""
    h = rows.select(doc, chunk_hash(text).alias("chunk_hash"))
    return h.groupBy("chunk_hash").agg(F.count_distinct(doc).alias("documents"), F.count("*").alias("lines")).filter(F.col("documents") >= least)
