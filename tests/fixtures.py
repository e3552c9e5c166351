"""A small graph of three pages in two documents, with the expected results of FIXTURES.md."""

from ledgerloom.sources.schemas import PAGES_EXTRACTED


def n(name, kind, **p):
    return (name, kind, p)


def e(source, relation, target, confidence=None):
    return (source, relation, target, {} if confidence is None else {"confidence": str(confidence)})


PAGES = [
    ("D1", 1, [n("Acme Aerospace", "Party"), n("Acme International Inc.", "Party"), n("C-1001", "Contract"), n("STD-9", "Standard")], [e("Acme Aerospace", "PARTY_TO", "C-1001"), e("C-1001", "REFERENCES_STANDARD", "STD-9", 0.9), e("C-1001", "REFERENCES_STANDARD", "STD-9", 0.6)]),
    ("D1", 2, [n("Lone Site", "Site"), n("", "Party")], [e("C-1001", "HAS_MILESTONE", "PDR"), e("C-1001", None, "Acme Aerospace"), e(None, "DUE_TO", "PDR")]),
    ("D2", 1, [n("Space Group", "Party"), n("STD-9", "Requirement"), n("Loop", "Goal")], [e("Loop", "SAME_AS", "Loop", 0.75)]),
]


def pages(spark):
    rows = [(doc, page, f"text of {doc}", "ok", None, nodes, edges, [("Widget", "not listed")]) for doc, page, nodes, edges in PAGES]
    return spark.createDataFrame(rows, PAGES_EXTRACTED)
