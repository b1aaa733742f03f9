"""Registered queries over the given tables, each with its SQL for another engine where SQL can say it."""

from __future__ import annotations

from seqloom.plans import query_alleles, query_assembly, query_counts, query_kmers, query_reports, query_tables, query_taxonomy  # noqa: F401
from seqloom.plans.registry import ORACLES, QUERIES, Query
from seqloom.plans.views import with_views


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: with_views(*parts) for name, parts in ORACLES.items()}
