"""All core queries, gathered from the plan modules."""

from __future__ import annotations

from talkgrid.plans import captions, checks, intervals, judging, listing, metrics, retrieval, stages, upkeep

MODULES = [intervals, captions, retrieval, metrics, judging, stages, checks, listing, upkeep]
FLAGSHIP = "rrf_fuse"


def queries() -> dict:
    """Name -> callable of every core query."""
    return {k: v for m in MODULES for k, v in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> SQL of every core query that has one."""
    return {k: v for m in MODULES for k, v in m.R.sql.items()}
