"""The registry of the library's queries and their SQL twins."""

from __future__ import annotations

from .plans import conditional, further, numeric, relational, scalars

_FAMILIES = (conditional, relational, scalars, numeric, further)


def queries() -> dict:
    return {name: f for family in _FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
