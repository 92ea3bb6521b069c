"""Registered queries: a Spark plan each and, where SQL can say the same, its SQL."""

from __future__ import annotations

from tidemark.plans import events, relational, streams, texts, user_functions, vectors
from tidemark.plans.registry import Query

QUERIES: dict[str, Query] = {
    **relational.QUERIES,
    **events.QUERIES,
    **user_functions.QUERIES,
    **streams.QUERIES,
    **texts.QUERIES,
    **vectors.QUERIES,
}

__all__ = ["QUERIES", "Query"]
