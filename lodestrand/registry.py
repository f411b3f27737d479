"""Collects the queries of the plan modules and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


_entries: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: make a (spark, sf_dir) function a named query, with SQL that gives the same rows."""

    def add(query: Query) -> Query:
        if name in _entries:
            raise ValueError(f"query {name} is registered twice")
        _entries[name] = Entry(query, sql)
        return query

    return add


def _load() -> None:
    from lodestrand import plans

    plans.load_all()


def queries() -> dict[str, Query]:
    _load()
    return {name: e.query for name, e in _entries.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: e.sql for name, e in _entries.items() if e.sql is not None}
