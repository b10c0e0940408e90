"""Named queries over the star schema, and their SQL equivalents."""

from __future__ import annotations

from quillon.plans import evaluation, invariants, modelling, preprocessing
from quillon.plans.tables import Query

_MODULES = (preprocessing, evaluation, modelling, invariants)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
