"""Named queries and the SQL each one is checked against."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name, with the equivalent SQL where there is one."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap
