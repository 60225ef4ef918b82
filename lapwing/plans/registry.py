"""The table of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from lapwing.sources.results import RESULTS_SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_results: bool = True):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + RESULTS_SQL + "," if with_results else "WITH ") + sql.strip().removeprefix("WITH ")
        return f

    return add
