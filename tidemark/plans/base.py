"""Registering a query together with its SQL."""

from __future__ import annotations

from tidemark.plans.sql import sql


class Plans:
    """Queries and oracles of one module."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict = {}

    def add(self, name: str, oracle: str | None = None, **own: str):
        """Decorator: registers f(spark, sf_dir) under name; oracle is the SQL body after the canonical tables."""

        def put(f):
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = sql(oracle, **own)
            return f

        return put
