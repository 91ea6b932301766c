"""All registered queries: name to (callable, SQL twin or None)."""

from __future__ import annotations


def all_queries() -> dict[str, tuple]:
    from . import app_queries, replay_queries, statement_queries, table_queries  # noqa: F401  (registers its queries)

    return dict(statement_queries.QUERIES)
