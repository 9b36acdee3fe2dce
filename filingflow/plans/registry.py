"""How plans register their queries."""

from __future__ import annotations


class Registry:
    def __init__(self, views: str = ""):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}
        self.views = views

    def __call__(self, name: str, sql: str | None = None):
        """sql: a SELECT over the plan's views; beginning with a comma, it adds views of its own."""

        def register(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = f"WITH RECURSIVE {self.views}{sql}" if self.views and sql.startswith(",") else f"WITH RECURSIVE {self.views}\n{sql}" if self.views else sql
            return f

        return register
