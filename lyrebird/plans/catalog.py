"""The registry of named queries: a builder and, where SQL can say the same, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a builder under a name."""

    def register(builder: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = builder
        if sql is not None:
            SQL[name] = sql
        return builder

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from lyrebird.plans import arrays, audio, evaluation, names, records, relational, runs, sampling, segments, sessions, stores, tensors, texts, vectors  # noqa: F401
