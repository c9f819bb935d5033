"""Names of the library's own queries and their SQL."""

from __future__ import annotations

from . import queries as over_tables
from . import stored
from .oracles import SQL


def queries() -> dict:
    return over_tables.QUERIES | stored.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
