"""Every query by name, over whole tables, with the statement it is held against."""

from __future__ import annotations

from lodestrata.plans import code, graphs, ledgers, lookups, modules, more, relational, retrieval, scalars, single, sources, streams, texts, tools
from lodestrata.plans.registry import Query

_PARTS = (scalars, code, retrieval, ledgers, graphs, more, relational, streams, sources, lookups, texts, tools, single, modules)


def queries() -> dict[str, Query]:
    return {k: q for p in _PARTS for k, q in p.R.made.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for p in _PARTS for k, q in p.R.sql.items()}
