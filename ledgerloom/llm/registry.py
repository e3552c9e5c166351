"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from ledgerloom.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
