"""How a module registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Registers the decorated function under its name, with the SQL for the same rows if there is any."""

        def keep(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql is not None:
                self.sql[function.__name__] = sql
            return function

        return keep
