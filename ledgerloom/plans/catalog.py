"""All queries of the contract-graph engine."""

from __future__ import annotations

from ledgerloom.plans import graph_queries, ingest_queries, retrieval_queries, revision_queries
from ledgerloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph_queries", "ingest_queries", "retrieval_queries", "revision_queries"]
