"""All registered queries of the core library and the SQL that must give the same rows."""

from __future__ import annotations

from . import candidates, cliffs, evaluation, features, fragments, metrics, modelling, packed, preparation

MODULES = (packed, preparation, cliffs, fragments, metrics, candidates, modelling, evaluation, features)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
