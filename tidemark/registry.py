"""Named queries with, where SQL can say it, an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Collects queries and their oracle SQL under unique names."""

    builders: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        """Decorator: register a (spark, sf_dir) -> DataFrame builder."""

        def add(fn: Query) -> Query:
            if name in self.builders:
                raise ValueError(f"query {name} is registered twice")
            self.builders[name] = fn
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return add
