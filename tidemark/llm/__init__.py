"""Operators for training data. Nothing else in the library imports this package."""

from __future__ import annotations

from tidemark.llm import queries as _queries
from tidemark.llm import sql as _sql

QUERIES = _queries.QUERIES
ORACLES = _sql.ORACLES
