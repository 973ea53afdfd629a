"""Collects a module's queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.facts import Tables


class Register:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        """Decorates a function of `Tables`; the query gets (spark, sf_dir)."""

        def add(function):
            self.queries[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
            if sql:
                self.oracles[name] = sql
            return function

        return add
