"""All queries of the reference operators, and their SQL."""

from __future__ import annotations

from lamella.operators import alignment, composition, counts, crosswalk, factors, geometry, identifiers, inference, linkage, masks, matched, models, particles, ranks, reshape, selection, volumes
from lamella.sources import matrices
from lamella.streaming import windows

_MODULES = (composition, linkage, ranks, counts, particles, inference, reshape, factors, volumes, identifiers, crosswalk, matched, geometry, models, selection, matrices, masks, alignment, windows)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
