"""Extraction boundaries: pages to nodes and edges, images to insights.

Models and parsers are replaceable callables; the defaults here are deterministic and need no service. Attempts are repeated inside the partition,
and a page that fails keeps its row with its error, so that it is told apart from a page that has nothing.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ledgerloom.sources.schemas import DOCUMENT_TYPES, EMPTY_PAGE, IMAGE_SIDE, PAGE_INSIGHTS, PAGES_EXTRACTED

INSIGHT_FIELDS = [
    "document_type_guess", "section_heading", "parties", "dates_or_milestones", "monetary_values", "cross_document_references",
    "tables_detected", "confidentiality_marking", "has_signature", "notes",
]

Extractor = Callable[[str], dict]
Parser = Callable[[bytes], list[str]]

_CONTRACT = re.compile(r"\bC-\d{3,}\b")
_STANDARD = re.compile(r"\b(?:STD|ISO|AD)-\d+\b")
_PARTY = re.compile(r"\b[A-Z][a-z]+ (?:Inc|LLC|Corp|Group|Aerospace|Systems)\b\.?")


def by_patterns(text: str) -> dict:
    """The default extractor: contracts, standards and companies by patterns, linked on one page."""
    contracts, standards, parties = (list(dict.fromkeys(p.findall(text))) for p in (_CONTRACT, _STANDARD, _PARTY))
    nodes = [{"name": n, "type": t, "properties": {}} for t, names in (("Contract", contracts), ("Standard", standards), ("Party", parties)) for n in names]
    edges = [{"source": p, "relation": "PARTY_TO", "target": c, "properties": {}} for c in contracts for p in parties]
    edges += [{"source": c, "relation": "REFERENCES_STANDARD", "target": s, "properties": {}} for c in contracts for s in standards]
    return {"nodes": nodes, "edges": edges, "suggested_new_types": []}


def attempt(call: Callable, tries: int, wait: Callable[[int], float]):
    """(result, None), or (None, error) after all tries."""
    for k in range(1, tries + 1):
        try:
            return call(), None
        except Exception as e:  # a boundary: whatever a model or parser raises becomes the row's error
            error = f"{type(e).__name__}: {e}"
            if k < tries:
                time.sleep(wait(k))
    return None, error


def split_pages(content: bytes) -> list[str]:
    """The default parser: text with form feeds between pages."""
    return content.decode("utf-8", "replace").split("\f")


def page_texts(files: DataFrame, parser: Parser = split_pages) -> DataFrame:
    """(doc, page, raw_text, status, error) of files (path, content); pages count from 1, a file that cannot be parsed is one failed row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                doc = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
                pages, error = attempt(lambda c=content: parser(bytes(c)), 1, float)
                rows += [(doc, 0, None, "failed", error)] if error else [(doc, k, t or "", "ok", None) for k, t in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["doc", "page", "raw_text", "status", "error"])

    return files.select("path", "content").mapInPandas(run, "doc string, page int, raw_text string, status string, error string")


def extract(pages: DataFrame, extractor: Extractor = by_patterns, tries: int = 3, pause: float = 2.0) -> DataFrame:
    """Pages with their nodes, edges and suggested types. Blank pages are not sent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, text, status, error in pdf[["doc", "page", "raw_text", "status", "error"]].itertuples(index=False):
                found = EMPTY_PAGE
                if status == "ok" and text and text.strip():
                    got, error = attempt(lambda t=text: extractor(t), tries, lambda k: pause * k)
                    status, found = ("ok", got) if error is None else ("failed", EMPTY_PAGE)
                rows.append((doc, page, text, status, error, found.get("nodes", []), found.get("edges", []), found.get("suggested_new_types", [])))
            yield pd.DataFrame(rows, columns=["doc", "page", "raw_text", "status", "error", "nodes", "edges", "suggested_new_types"])

    return pages.mapInPandas(run, PAGES_EXTRACTED)


def image_insights(files: DataFrame, reader: Callable[[bytes], str], tries: int = 3, pause: float = 1.0, parallel: int = 4) -> DataFrame:
    """Insights (PAGE_INSIGHTS) of images (path, content): ``reader`` gives a model's JSON. Order is restored by the file's name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                got, error = attempt(lambda c=content: reader(bytes(c)), tries, lambda k: pause * 2**k)
                rows.append((path.rsplit("/", 1)[-1], got, error))
            yield pd.DataFrame(rows, columns=["_source_file", "json", "error"])

    raw = files.select("path", "content").repartition(parallel).mapInPandas(run, "_source_file string, json string, error string")
    fields = PAGE_INSIGHTS.split("error string, ", 1)[1]
    parsed = raw.withColumn("p", F.from_json("json", fields + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.when(F.col("p._corrupt").isNotNull(), F.lit("not the JSON that was asked for"))
    return parsed.select("_source_file", F.coalesce("error", bad).alias("error"), *(F.col(f"p.{n}").alias(n) for n in INSIGHT_FIELDS)).orderBy("_source_file")


def insight_violations(insights: DataFrame) -> DataFrame:
    """(_source_file, violations) of readable pages that break the rules: every field is there, if empty; a list's items have all their parts; the type is a known one.

    A page with an error, or one that says so in its notes, is no violation: it has its error.
    """
    absent = [F.when(F.col(n).isNull(), F.lit(f"no {n}")) for n in INSIGHT_FIELDS]
    lists = {f.name: f.dataType.elementType.names for f in insights.schema.fields if isinstance(f.dataType, ArrayType) and f.name in INSIGHT_FIELDS}
    gap = lambda names: lambda x: F.array_contains(F.array(*(x[n].isNull() for n in names)), True)
    parts = [F.when(F.exists(f, gap(names)), F.lit(f"incomplete {f}")) for f, names in lists.items()]
    unknown = F.when(~F.col("document_type_guess").isin(*DOCUMENT_TYPES), F.concat(F.lit("unknown type "), "document_type_guess"))
    found = F.filter(F.array(*absent, *parts, unknown), lambda x: x.isNotNull())
    return insights.filter("error is null").select("_source_file", found.alias("violations")).filter(F.size("violations") > 0)


def page_label(kind, error):
    """A page's document type, or its error."""
    return F.coalesce(kind, F.concat(F.lit("ERROR: "), error))


def fitted(width: int, height: int, side: int = IMAGE_SIDE) -> tuple[int, int]:
    """An image's size with its longest side at most ``side``."""
    longest = max(width, height)
    return (width, height) if longest <= side else (max(1, round(width * side / longest)), max(1, round(height * side / longest)))


def converted(files: DataFrame, done: DataFrame, convert: Callable[[bytes, Callable[[int, int], tuple[int, int]]], bytes], side: int = IMAGE_SIDE) -> DataFrame:
    """Images (path, content) that have no output yet, converted: (path, content, error). ``convert`` gets the content and the rule for sizes (``fitted``)."""
    sizes = partial(fitted, side=side)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *attempt(lambda c=c: convert(bytes(c), sizes), 1, float)) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return files.select("path", "content").join(done.select("path"), "path", "left_anti").mapInPandas(run, "path string, content binary, error string")
