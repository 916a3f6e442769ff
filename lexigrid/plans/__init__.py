"""Named queries over a folder of parquet tables, and the SQL that checks them."""

from __future__ import annotations

from lexigrid.plans.registry import CHECKS, QUERIES, Query


def _load() -> None:
    from lexigrid.plans import (  # noqa: F401
        catalog_queries, evaluate_queries, place_queries, profile_queries, set_queries, text_queries, vector_queries)


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)
